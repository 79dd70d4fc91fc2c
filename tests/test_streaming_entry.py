import os
import sys

from pyspark.sql import functions as F

from tokenloom.operators.router import domain_specialization
from tokenloom.session import checkpoint_dir
from tokenloom.streaming.router_stream import start_update, stream_source, streaming_expert_counts

SF = "/root/testdata/sf0.001"


def test_streaming_counts_equal_batch(spark, tmp_path):
    src = tmp_path / "emb"
    spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3).write.parquet(str(src))
    s = stream_source(spark, str(src), "vec_id long, embedding array<float>, label int", max_files_per_trigger=1)
    rec = s.select(F.col("label").alias("domain"), F.array(F.array("embedding")).alias("router_logits"))
    counts, _ = streaming_expert_counts(rec, k=8)
    q = start_update(counts, name="stream_counts", checkpoint=str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = {(r.domain, r.layer, r.expert): r.n for r in spark.table("stream_counts").collect()}
    batch = domain_specialization(spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("label").alias("domain"), F.array(F.array("embedding")).alias("router_logits")), k=8)
    want = {(r.domain, r.layer, r.expert): r.n for r in batch.collect() if r.n > 0}
    assert got == want


def test_entry_contract(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["domain", "layer", "expert", "n", "share"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert checkpoint_dir(spark)


def test_streaming_token_totals(spark, tmp_path):
    from tokenloom.functions.text import ws_tokens
    from tokenloom.streaming.router_stream import streaming_token_totals

    src = tmp_path / "docs"
    spark.read.parquet(f"{SF}/documents.parquet").repartition(4).write.parquet(str(src))
    s = stream_source(spark, str(src), "doc_id long, text string, lang string, source string, n_chars long",
                      max_files_per_trigger=2)
    totals = streaming_token_totals(s.select("source", F.size(ws_tokens("text")).alias("n_tokens")))
    q = start_update(totals, name="stream_totals", checkpoint=str(tmp_path / "ckpt2"))
    q.processAllAvailable()
    q.stop()
    got = {r.source: r.total_tokens for r in spark.table("stream_totals").collect()}
    want = {r.source: r.t for r in spark.read.parquet(f"{SF}/documents.parquet")
            .groupBy("source").agg(F.sum(F.size(ws_tokens("text"))).alias("t")).collect()}
    assert got == want


def test_streaming_state_to_shares(spark, tmp_path):
    from tokenloom.streaming.router_stream import latest_state, shares_from_state

    src = tmp_path / "emb"
    spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3).write.parquet(str(src))
    s = stream_source(spark, str(src), "vec_id long, embedding array<float>, label int", max_files_per_trigger=1)
    rec = s.select(F.col("label").alias("domain"), F.array(F.array("embedding")).alias("router_logits"))
    counts, totals = streaming_expert_counts(rec, k=8)
    qs = [start_update(counts, name="c", checkpoint=str(tmp_path / "ck1"), sink="parquet", path=str(tmp_path / "c")),
          start_update(totals, name="t", checkpoint=str(tmp_path / "ck2"), sink="parquet", path=str(tmp_path / "t"))]
    for q in qs:
        q.processAllAvailable()
        q.stop()
    got = shares_from_state(latest_state(spark, str(tmp_path / "c"), ["domain", "layer", "expert"]),
                            latest_state(spark, str(tmp_path / "t"), ["domain"]))
    batch = domain_specialization(spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("label").alias("domain"), F.array(F.array("embedding")).alias("router_logits")), k=8)
    norm = lambda df: sorted((r.domain, r.layer, r.expert, r.n, round(r.share, 9)) for r in df.collect())
    assert norm(got) == norm(batch)
