"""Training-row queries: tokenisation, packing, flat token stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.packing import EOS_ID, flat_token_stream, pack_sequences
from tokenloom.operators.tokenize import tokenize
from tokenloom.plans.registry import query, table

# The SQL oracles tokenise exactly like tokenloom.functions.text.ws_tokens/token_id.
TOKENS_SQL = r"list_filter(string_split_regex({t}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
IDS_SQL = r"list_transform(" + TOKENS_SQL + r", lambda x: ('0x' || substr(md5(x), 1, 7))::INTEGER)"

PACK_CTE = f"""
WITH t AS (
  SELECT doc_id, list_append({IDS_SQL.format(t='text')}, {EOS_ID}) AS ids FROM documents
), o AS (
  SELECT ids, sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              - len(ids) AS off FROM t
), f AS (
  SELECT off + generate_subscripts(ids, 1) - 1 AS g, unnest(ids) AS tok FROM o
), full_chunks AS (
  SELECT g // 512 AS chunk FROM f GROUP BY 1 HAVING count(*) = 512
)
"""


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokens_col=None)
    return pack_sequences(docs, 512, "doc_id")


@query("packed_sequences", PACK_CTE + """
SELECT (g // 512)::BIGINT AS chunk, count(*)::BIGINT AS n_tokens, sum(tok)::BIGINT AS id_sum,
       md5(string_agg(tok::VARCHAR, ' ' ORDER BY g)) AS ids_md5
FROM f WHERE g // 512 IN (SELECT chunk FROM full_chunks) GROUP BY 1
""")
def q_packed_sequences(spark, sf_dir):
    """I6 + E1 (+E2): whitespace tokens, ids + eos packed into 512-token rows, tail dropped."""
    p = packed(spark, sf_dir)
    return p.select(F.col("chunk").cast("long").alias("chunk"), F.size("input_ids").cast("long").alias("n_tokens"),
                    F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
                    F.md5(F.concat_ws(" ", F.transform("input_ids", lambda x: x.cast("string")))).alias("ids_md5"))


@query("flat_token_stream", PACK_CTE + """
SELECT (g // 4096)::BIGINT AS block, count(*)::BIGINT AS n_tokens, sum(tok)::BIGINT AS id_sum,
       count(*)::BIGINT AS mask_sum, min(g)::BIGINT AS first_pos
FROM f WHERE g // 512 IN (SELECT chunk FROM full_chunks) GROUP BY 1
""")
def q_flat_token_stream(spark, sf_dir):
    """Packed rows as a flat (pos, token_id, mask) stream, summarised per 4096-position block."""
    s = flat_token_stream(packed(spark, sf_dir), 512)
    return (s.groupBy(F.floor(F.col("pos") / 4096).cast("long").alias("block"))
            .agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("token_id").cast("long").alias("id_sum"),
                 F.sum("mask").cast("long").alias("mask_sum"), F.min("pos").alias("first_pos")))


@query("token_ids", f"""
SELECT doc_id, len({TOKENS_SQL.format(t='text')})::INTEGER AS n_tokens,
       md5(array_to_string({IDS_SQL.format(t='text')}, ' ')) AS ids_md5
FROM documents
""")
def q_token_ids(spark, sf_dir):
    """Built-in tokenisation of every document (count and id fingerprint)."""
    t = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return t.select("doc_id", F.size("input_ids").alias("n_tokens"),
                    F.md5(F.concat_ws(" ", F.transform("input_ids", lambda x: x.cast("string")))).alias("ids_md5"))
