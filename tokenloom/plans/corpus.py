"""Corpus-preparation and ordering queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.text import fingerprint
from tokenloom.operators.corpus import prepare_corpus
from tokenloom.operators.ordering import batches, contiguous_chunks, line_shards, named_splits
from tokenloom.plans.registry import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Projections and rank-only plans: no per-row CPU work worth spreading a few-file input for.
    return table(spark, sf_dir, "documents", spread=False)


@query("prepare_corpus_orig", """
SELECT md5(text) AS id, source, text FROM documents WHERE text IS NOT NULL AND text <> ''
""")
def q_prepare_corpus_orig(spark, sf_dir):
    """B1 + B2 + B9 (pubmed_orig)."""
    return prepare_corpus(_docs(spark, sf_dir), "pubmed_orig", source="source")


@query("prepare_corpus_hashprefix", """
SELECT md5(text) AS id, source, substr(md5(text), 1, 5) || text AS text
FROM documents WHERE text IS NOT NULL AND text <> ''
""")
def q_prepare_corpus_hashprefix(spark, sf_dir):
    """5 hex chars of md5 before the text."""
    return prepare_corpus(_docs(spark, sf_dir), "pubmed_hashprefix", source="source", prefix_length=5)


@query("prepare_corpus_reservedprefix", """
SELECT md5(text) AS id, source, repeat('<|extra_id_0|>', 20) || text AS text
FROM documents WHERE text IS NOT NULL AND text <> ''
""")
def q_prepare_corpus_reservedprefix(spark, sf_dir):
    """20 reserved tokens before the text."""
    return prepare_corpus(_docs(spark, sf_dir), "pubmed_reservedprefix", source="source",
                          tokenizer_name="allenai/OLMo-2-1124-7B", prefix_length=20)


_PARTS = ", ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
                   for c in ("doc_id", "text", "lang", "source", "n_chars"))


@query("row_fingerprint", f"SELECT doc_id, md5(concat_ws(chr(31), {_PARTS})) AS fingerprint FROM documents")
def q_row_fingerprint(spark, sf_dir):
    """H2: md5 over a row's values."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", fingerprint("doc_id", "text", "lang", "source", "n_chars").alias("fingerprint"))


@query("jsonl_shards", """
WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT ((rn - 1) // greatest(1, n // 128))::BIGINT AS shard, count(*)::BIGINT AS n_rows
FROM r GROUP BY 1
""")
def q_jsonl_shards(spark, sf_dir):
    """A10 + E5 + E2: rows per line shard (at least 128 shards)."""
    s = line_shards(_docs(spark, sf_dir).select("doc_id"), 128, "doc_id")
    return s.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))


@query("contiguous_chunks", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents),
c AS (SELECT doc_id, ((rn - 1) // CASE WHEN n >= 32 THEN n // 32 + 1 ELSE 1 END)::BIGINT AS chunk FROM r)
SELECT chunk, count(*)::BIGINT AS n_rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM c GROUP BY 1
""")
def q_contiguous_chunks(spark, sf_dir):
    """E5 + E2: 32 contiguous chunks of the document order."""
    c = contiguous_chunks(_docs(spark, sf_dir).select("doc_id"), 32, "doc_id")
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_doc"),
                                  F.max("doc_id").alias("last_doc"))


@query("batches", """
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
SELECT ((rn - 1) // 16)::BIGINT AS batch_id, count(*)::BIGINT AS n_rows, min(doc_id) AS first_doc,
       sum(n_chars)::BIGINT AS n_chars
FROM r GROUP BY 1
""")
def q_batches(spark, sf_dir):
    """E4 + E2: batches of 16 documents."""
    b = batches(_docs(spark, sf_dir).select("doc_id", "n_chars"), 16, "doc_id")
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_doc"),
                                     F.sum("n_chars").alias("n_chars"))


@query("named_splits", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, rn::BIGINT AS rank,
       CASE WHEN rn <= floor(0.8 * n) THEN 'train'
            WHEN rn <= floor(0.8 * n) + floor(0.1 * n) THEN 'valid'
            WHEN rn <= floor(0.8 * n) + floor(0.1 * n) + floor(0.05 * n) THEN 'test' END AS split
FROM r
""")
def q_named_splits(spark, sf_dir):
    """E3 + D10: train/valid/test = 80/10/5 % of the order; the rest unassigned (NULL)."""
    s = named_splits(_docs(spark, sf_dir).select("doc_id"), {"train": 0.8, "valid": 0.1, "test": 0.05}, "doc_id")
    return s.select("doc_id", "rank", "split")
