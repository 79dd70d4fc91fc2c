"""Router-analytics queries over the driver tables.

``embeddings`` stands in for saved router logits: ``label`` is the domain,
``vec_id`` the token/instance and the 64 floats the experts of one layer.
``conversations`` stands in for request/prediction files: a user turn is a
request, the next assistant turn its prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.tensors import reshape
from tokenloom.operators.router import (
    attach_correct,
    domain_specialization,
    pair_requests_predictions,
    row_count_parity,
)
from tokenloom.plans.registry import query, table
from tokenloom.session import scratch
from tokenloom.sources.readers import read_router_records
from tokenloom.sources.writers import write_router_files


def router_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One router record per embedding: tensor ``[1 layer][1 token][64 experts]``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("domain"),
                    F.array(F.array(F.col("embedding"))).alias("router_logits"))


def _spec_out(df: DataFrame) -> DataFrame:
    return df.select("domain", "layer", "expert", "n", F.round("share", 6).alias("share"))


SPEC_SQL = """
WITH tok AS (
  SELECT vec_id, label AS domain, unnest(embedding) AS v,
         generate_subscripts(embedding, 1) - 1 AS expert
  FROM embeddings WHERE NOT list_any_value(list_transform(embedding, lambda x: isnan(x))) IS TRUE {where}
), ranked AS (
  SELECT domain, expert, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, expert) AS r FROM tok
), counts AS (
  SELECT domain, expert, count(*) AS n FROM ranked WHERE r <= {k} GROUP BY domain, expert
), totals AS (
  SELECT domain, count(DISTINCT vec_id) AS total, max(expert) + 1 AS ne FROM tok GROUP BY domain
), grid AS (
  SELECT domain, x.e AS expert, total FROM totals, range(64) AS x(e) WHERE x.e < ne
)
SELECT g.domain::INTEGER AS domain, 0::INTEGER AS layer, g.expert::INTEGER AS expert,
       coalesce(c.n, 0)::BIGINT AS n, round(coalesce(c.n, 0) / g.total, 6) AS share
FROM grid g LEFT JOIN counts c ON g.domain = c.domain AND g.expert = c.expert
"""


@query("domain_specialization", SPEC_SQL.format(k=8, where=""))
def q_domain_specialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + D1 + D2: per (domain, layer, expert) top-8 counts and shares, zero-filled."""
    return _spec_out(domain_specialization(router_records(spark, sf_dir), k=8))


@query("correct_only_specialization", SPEC_SQL.format(
    k=8, where="AND vec_id IN (SELECT doc_id FROM labels WHERE quality > 0 OR toxic > 0)"))
def q_correct_only_specialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 + B5 + D2: only instances whose prediction metrics mark them correct.

    ``labels`` plays the prediction file: metrics ``{exact_match: quality, f1: toxic}``
    keyed by ``doc_id`` = ``vec_id``.
    """
    preds = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("vec_id"),
        F.create_map(F.lit("exact_match"), F.col("quality").cast("double"),
                     F.lit("f1"), F.col("toxic").cast("double")).alias("metrics"))
    kept = attach_correct(router_records(spark, sf_dir), preds, keys=["vec_id"])
    return _spec_out(domain_specialization(kept, k=8))


LAYERED_SQL = """
WITH e AS (
  SELECT vec_id, label AS domain, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i
  FROM embeddings
), t AS (
  SELECT vec_id, domain, i // 32 AS layer, (i % 32) // 8 AS tok, i % 8 AS expert, v FROM e
), r AS (
  SELECT domain, layer, expert,
         row_number() OVER (PARTITION BY vec_id, layer, tok ORDER BY v DESC, expert) AS rn
  FROM t WHERE tok >= 1
), c AS (
  SELECT domain, layer, expert, count(*) AS n FROM r WHERE rn <= 2 GROUP BY ALL
), tot AS (
  SELECT label AS domain, 3 * count(*) AS total FROM embeddings GROUP BY label
), g AS (
  SELECT domain, a.l AS layer, b.x AS expert, total FROM tot, range(2) AS a(l), range(8) AS b(x)
)
SELECT g.domain::INTEGER AS domain, g.layer::INTEGER AS layer, g.expert::INTEGER AS expert,
       coalesce(c.n, 0)::BIGINT AS n, round(coalesce(c.n, 0) / g.total, 6) AS share
FROM g LEFT JOIN c ON g.domain = c.domain AND g.layer = c.layer AND g.expert = c.expert
"""


@query("router_topk_layered", LAYERED_SQL)
def q_router_topk_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H23 + H22 + F1 + D1: 64 values as ``[2 layers][4 tokens][8 experts]``, boundary token 1, k=2."""
    e = table(spark, sf_dir, "embeddings")
    rec = e.select(F.col("label").alias("domain"), reshape("embedding", [2, 4, 8]).alias("router_logits"),
                   F.lit(1).alias("token_index"))
    return _spec_out(domain_specialization(rec, k=2, token_index="token_index"))


def chat_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations", spread=False)
    req = (c.where(F.col("role") == "user")
           .select(F.lit("chat").alias("domain"), "conv_id",
                   F.concat_ws(":", "conv_id", "turn").alias("native_id"), F.col("text").alias("context")))
    pred = (c.where(F.col("role") == "assistant")
            .select(F.lit("chat").alias("domain"), "conv_id",
                    F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("native_id"),
                    F.array(F.struct(F.col("text").alias("continuation"))).alias("model_output")))
    return req, pred


@query("pair_requests_predictions", """
WITH req AS (
  SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS native_id, count(*) AS nreq, min(text) AS ctx
  FROM conversations WHERE role = 'user' GROUP BY 1
), pred AS (
  SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS native_id, count(*) AS npred, min(text) AS cont
  FROM conversations WHERE role = 'assistant' GROUP BY 1
), j AS (
  SELECT coalesce(req.native_id, pred.native_id) AS native_id, nreq, npred, ctx, cont,
         CASE WHEN nreq IS NULL THEN 'missing_request' WHEN npred IS NULL THEN 'missing_prediction'
              WHEN nreq > 1 OR npred > 1 THEN 'duplicate_id' END AS violation
  FROM req FULL OUTER JOIN pred ON req.native_id = pred.native_id
)
SELECT 'chat' AS domain, native_id,
       CASE WHEN violation IS NULL THEN ctx || cont END AS prompt,
       CASE WHEN violation IS NULL THEN length(ctx) END::INTEGER AS "index", violation
FROM j
""")
def q_pair_requests_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request/prediction pairing with violations instead of asserts."""
    req, pred = chat_requests(spark, sf_dir)
    return pair_requests_predictions(req, pred)


@query("request_prediction_parity", """
WITH l AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1),
     r AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.n, 0)::BIGINT AS n_left,
       coalesce(r.n, 0)::BIGINT AS n_right, coalesce(l.n, 0) = coalesce(r.n, 0) AS equal
FROM l FULL OUTER JOIN r ON l.conv_id = r.conv_id
""")
def q_request_prediction_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request and prediction row counts per conversation."""
    req, pred = chat_requests(spark, sf_dir)
    return row_count_parity(req, pred, by=["conv_id"])


@query("router_jsonl_roundtrip", LAYERED_SQL)
def q_router_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H22 -> A12 -> A4/A6 -> D2: records cut at their boundary token once, before they are written as JSON lines (one
    directory per domain) to the shared checkpoint folder; read back with an explicit schema, then counted whole."""
    import uuid

    from tokenloom.functions.tensors import slice_tokens
    from tokenloom.session import checkpoint_dir
    from tokenloom.sources.readers import ROUTER_SCHEMA, load_jsonl
    from tokenloom.sources.writers import write_results

    whole = reshape("embedding", [2, 4, 8]).cast("array<array<array<double>>>")
    rec = table(spark, sf_dir, "embeddings").select(
        F.concat_ws(":", F.lit("vec"), "vec_id").alias("prompt"), F.lit(1).alias("token_index"),
        slice_tokens(whole, 1).alias("router_logits"), F.col("label").alias("domain"))
    path = f"{checkpoint_dir(spark)}/router-{uuid.uuid4().hex}"
    write_results(rec, path, "router", partition_by="domain")
    back = load_jsonl(spark, path, ROUTER_SCHEMA + ", domain int")
    return _spec_out(domain_specialization(back, k=2))


@query("pair_violations", """
WITH req AS (
  SELECT conv_id, turn, text AS ctx, CASE WHEN conv_id % 5 = 1 AND turn < 2 THEN 2 ELSE 1 END AS nreq FROM conversations
  WHERE role = 'user' AND NOT (conv_id % 7 = 2 AND turn < 2)
), pred AS (
  SELECT conv_id, turn - 1 AS turn, text AS cont, CASE WHEN conv_id % 3 = 1 AND turn < 3 THEN 0 WHEN conv_id % 3 = 2 AND turn < 3 THEN 2 ELSE 1 END AS nout
  FROM conversations WHERE role = 'assistant' AND conv_id % 11 <> 3
), j AS (
  SELECT CASE WHEN nreq IS NULL THEN 'missing_request' WHEN nout IS NULL THEN 'missing_prediction' WHEN nreq > 1 THEN 'duplicate_id'
              WHEN nout <> 1 THEN 'bad_output_count' END AS violation, ctx, cont
  FROM req FULL OUTER JOIN pred ON req.conv_id = pred.conv_id AND req.turn = pred.turn
)
SELECT coalesce(violation, 'none') AS violation, count(*)::BIGINT AS n,
       sum(CASE WHEN violation IS NULL THEN length(ctx || cont) END)::BIGINT AS prompt_chars FROM j GROUP BY 1
""")
def q_pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are there twice or not at all, predictions with no output, two or none at all: each has its violation."""
    req, pred = chat_requests(spark, sf_dir)
    turn = F.element_at(F.split("native_id", ":"), -1).cast("int")
    req = req.where(~((F.col("conv_id") % 7 == 2) & (turn < 2)))
    req = req.unionByName(req.where((F.col("conv_id") % 5 == 1) & (turn < 2)))
    outputs = F.when((F.col("conv_id") % 3 == 1) & (turn < 2), F.slice("model_output", 1, 0)).when(
        (F.col("conv_id") % 3 == 2) & (turn < 2), F.concat("model_output", "model_output")).otherwise(F.col("model_output"))
    pred = pred.where("conv_id % 11 <> 3").withColumn("model_output", outputs)
    x = pair_requests_predictions(req, pred)
    return x.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("prompt")).alias("prompt_chars"))


@query("router_domain_files", """
SELECT label::VARCHAR AS domain, count(*)::BIGINT AS n_records, count(*)::BIGINT - 1 AS last_line,
       'vec:' || min(vec_id)::VARCHAR AS first_prompt, round(sum(embedding[1]::DOUBLE), 4) AS logit_sum FROM embeddings GROUP BY label
""")
def q_router_domain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router records written as ``<domain>-router.jsonl`` (parts in order), found by that name and read back with
    the domain from the name and line numbers over the parts."""
    rec = router_records(spark, sf_dir).select(
        "domain", "vec_id", F.concat_ws(":", F.lit("vec"), "vec_id").alias("prompt"), F.lit(0).alias("token_index"),
        F.col("router_logits").cast("array<array<array<double>>>").alias("router_logits"))
    write_router_files(rec, path := scratch(spark, "router-domains"), order=["vec_id"], files=8)
    back = read_router_records(spark, path, ordered=True)
    return back.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_records"), F.max("line_no").alias("last_line"), F.min_by("prompt", "line_no").alias("first_prompt"),
        F.round(F.sum(F.col("router_logits")[0][0][0]), 4).alias("logit_sum"))
