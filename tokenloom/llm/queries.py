"""One query an operator, over its whole table, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import table
from tokenloom.llm.exact_topk import exact_topk, floors
from tokenloom.llm.hnsw import nearest
from tokenloom.llm.license_scan import BASE, TEMPLATES, scan
from tokenloom.llm.line_spread import dedup_lines
from tokenloom.llm.merkle import manifest, tampered_ids, verify
from tokenloom.llm.mixing import mix
from tokenloom.llm.oracles import license_sql, merkle_sql
from tokenloom.llm.piece_bpe import digests
from tokenloom.llm.pseudonyms import KINDS, pseudonyms
from tokenloom.llm.quality_knn import classify
from tokenloom.llm.simhash_bk import simhash_groups
from tokenloom.llm.slots import shard
from tokenloom.llm.url_rules import judge
from tokenloom.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_exact_topk", r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: the 5 largest integer inner products of every vector whose id is divisible by 50."""
    v = floors(table(spark, sf_dir, "embeddings"))
    return exact_topk(v, v.filter(F.col("vec_id") % 50 == 0), 5)


@query("op2_url_rules")
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: every page's verdict; a page is labelled bad if its labels row (same id) is low in quality or toxic."""
    bad = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).dropna()
    return judge(table(spark, sf_dir, "pages"), bad)


@query("op3_mixing", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
      FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[i % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS bound FROM s),
o AS (SELECT *, bound / w AS ratio, row_number() OVER (ORDER BY bound / w, i) AS k FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())
        - coalesce(sum(bound) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        AS level FROM o),
t AS (SELECT source, source_size, least(bound, coalesce(w * (SELECT arg_min(level, k) FROM l WHERE level <= ratio), bound))
        AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY source, h) AS tie FROM d)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN upto - tie / 2.0::DOUBLE <= target - passes * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
""")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: the mix of all documents by source."""
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def piece_model() -> str:
    """The public vocabulary file that operator 4 uses; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: every whole document text to ids and back."""
    return digests(table(spark, sf_dir, "documents"), piece_model())


#: The key of the registered query; a real run passes its own secret.
DEMO_KEY = b"public demonstration key"


@query("op5_pseudonyms")
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: every document with its personal numbers, dates and addresses replaced."""
    got = table(spark, sf_dir, "documents").select("doc_id", pseudonyms(F.col("text"), DEMO_KEY).alias("x"))
    return got.select("doc_id", "x.text", *[f"x.n_{k}" for k in KINDS])


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: quality score of every document, learnt from labels that aren't held out."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MIN_SITES = 5


@query("op7_line_dedup", rf"""
WITH d AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, source, trim(l, ' ' || chr(9) || chr(13)) AS l
      FROM (SELECT doc_id, source, unnest(lines) AS l FROM d)),
b AS (SELECT l, min(doc_id) AS first_doc FROM x WHERE length(l) > 0
      GROUP BY l HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}),
e AS (SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT e.doc_id, e.text, e.line, e.pos, b.l IS NOT NULL AND b.first_doc IS DISTINCT FROM e.doc_id AS gone
      FROM e LEFT JOIN b ON trim(e.line, ' ' || chr(9) || chr(13)) = b.l),
g AS (SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean,
             count(*) FILTER (WHERE gone) AS n_removed, count(*) AS n_lines FROM k GROUP BY doc_id, text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE g.clean END AS text,
       coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN g ON d.doc_id = g.doc_id AND d.text = g.text
""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: documents without the repeats of lines that five or more sources carry."""
    return dedup_lines(table(spark, sf_dir, "documents"), min_sites=MIN_SITES, counts=True)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: fingerprint and component of every document (3-word shingles, 3 bits)."""
    out = simhash_groups(table(spark, sf_dir, "documents"), words=3, max_distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_hnsw")
def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: the 20 nearest found of every vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.filter(F.col("vec_id") % 20 == 0), 20)


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: all documents in eight shards through 4096 virtual slots, near equal in bytes."""
    out = shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                      F.col("vslot").alias("virtual_slot"), "map_version")


@query("op11_licenses", license_sql(TEMPLATES, BASE))
def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: license phrases and accepted notices of every whole document text."""
    got = table(spark, sf_dir, "documents").select("doc_id", scan(F.col("text")).alias("x"))
    return got.select("doc_id", *[f"x.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                                                     "score")])


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: every vector on the leading 16 whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"), most=16)


@query("op13_merkle", merkle_sql())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: every document's leaf, roots and proof; every fifth document (by checksum) tampered with fails."""
    made = verify(manifest(table(spark, sf_dir, "documents"), tampered=tampered_ids()))
    return made.select("doc_id", "position", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
