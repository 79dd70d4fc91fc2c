"""Structured Streaming variants of D1-D3: incremental expert counts and token totals.

The batch operators are plain group-bys, so the same expressions run on a
``readStream`` file source; Spark keeps the running counts in its state store
(checkpointed in the shared folder) and emits changed groups in ``update`` mode.
Zero-filling and shares are derived from the state table by a batch read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.functions.tensors import slice_tokens, tensor_violation, topk_indices


def stream_source(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream with an explicit schema (no inference on a stream)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def streaming_expert_counts(records: DataFrame, *, k: int, domain: str = "domain", tensor: str = "router_logits",
                            token_index: str | None = None) -> tuple[DataFrame, DataFrame]:
    """D1 + D2 inputs on a stream: running ``(domain, layer, expert, n)`` and ``(domain, total_tokens)``."""
    t = F.col(tensor)
    if token_index:
        t = slice_tokens(t, F.col(token_index))
    base = records.select(F.col(domain).alias("domain"), t.alias("_t")).where(tensor_violation(F.col("_t")).isNull())
    hits = F.flatten(F.transform(F.col("_t"), lambda layer, li: F.flatten(
        F.transform(layer, lambda tok: F.transform(topk_indices(tok, k),
                                                   lambda e: F.struct(li.alias("layer"), e.alias("expert")))))))
    counts = (base.select("domain", F.inline(hits)).groupBy("domain", "layer", "expert")
              .agg(F.count(F.lit(1)).alias("n")))
    totals = base.groupBy("domain").agg(F.sum(F.size(F.get("_t", 0))).cast("long").alias("total_tokens"),
                                        F.max(F.size("_t")).alias("n_layers"),
                                        F.max(F.size(F.get(F.get("_t", 0), 0))).alias("n_experts"))
    return counts, totals


def streaming_token_totals(docs: DataFrame, *, by: str = "source", tokens: str = "n_tokens") -> DataFrame:
    """D3 on a stream: running token totals per group."""
    return docs.groupBy(by).agg(F.sum(tokens).cast("long").alias("total_tokens"))


def start_update(df: DataFrame, *, name: str, checkpoint: str, sink: str = "memory",
                 path: str | None = None) -> StreamingQuery:
    """Start a query: ``memory`` (complete mode, tests) or ``parquet`` (update mode; each
    micro-batch's changed rows are appended with their epoch through ``foreachBatch``)."""
    w = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).queryName(name)
    if sink == "memory":
        return w.format("memory").outputMode("complete").start()
    if sink != "parquet":
        raise ValueError("sink must be 'memory' or 'parquet'")
    if path is None:
        raise ValueError("path is required for a file sink")

    def append(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)

    return w.foreachBatch(append).start()


def latest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest value per key from the table ``start_update(..., sink='parquet')`` appends to.

    Update mode emits a row each time a key changes; ``max_by(..., epoch)`` per key is a
    bounded partial aggregate, so reading the state back needs no window or collect.
    """
    df = spark.read.parquet(path)
    vals = [c for c in df.columns if c not in keys and c != "epoch"]
    return df.groupBy(*keys).agg(*[F.max_by(c, "epoch").alias(c) for c in vals])


def shares_from_state(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """D2 from streamed state: zero-filled ``(domain, layer, expert, n, share)``.

    The grid is generated from the per-domain totals rows (tensor widths are part of the
    streamed state), so it matches the batch ``domain_specialization`` output.
    """
    shape = totals.select("domain", "total_tokens", (F.col("n_layers") - 1).alias("_ml"),
                          (F.col("n_experts") - 1).alias("_me"))
    grid = (shape.select("domain", "total_tokens", F.explode(F.sequence(F.lit(0), F.col("_ml"))).alias("layer"),
                         "_me")
            .select("domain", "total_tokens", "layer", F.explode(F.sequence(F.lit(0), F.col("_me"))).alias("expert")))
    out = grid.join(counts, ["domain", "layer", "expert"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("domain", "layer", "expert", F.col("n").cast("long").alias("n"),
                      (F.col("n") / F.col("total_tokens")).alias("share"))
