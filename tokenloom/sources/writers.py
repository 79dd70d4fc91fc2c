"""Sinks: A8 JSONL, A9 columnar shards, A10 gzip line shards, A12 result records,
A14 one directory per evaluator.

Row order in output files is carried by an explicit order column (written and
sorted within each file), never by funnelling everything through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.operators.ordering import contiguous_chunks, line_shards, prefix_sum


def write_jsonl(df: DataFrame, path: str, *, order: Sequence[str] | None = None, compression: str | None = None,
                files: int | None = None, partition_by: str | None = None, rows_per_file: int | None = None) -> None:
    """JSON lines. With ``order`` the rows are range-partitioned by it and sorted, so the part files in name order follow
    the order, and a manifest (file, first line, rows) is written beside them for ``load_ordered_jsonl``.

    ``partition_by`` makes a directory of each of its values, each with an order of its own; a common value has several part
    files, so no task holds more than a range. With ``rows_per_file`` the rows of each directory are numbered first and every file
    of it but the last has just so many; whole files are dealt to tasks.
    """
    folder = [partition_by] if partition_by else []
    keys = [*folder, *(order or [])]
    out = df
    if rows_per_file:
        if not order:
            raise ValueError("rows_per_file needs an order")
        out = prefix_sum(df, order, partition=folder, start_col="__line", total_col=None, ties=True)
        out = out.withColumn("__file", F.floor(F.col("__line") / rows_per_file))
        parts = [*([files] if files else []), *folder, "__file"]
        out = out.repartitionByRange(*parts).sortWithinPartitions(*folder, "__line").drop("__line", "__file")
    elif order:
        parts = out.repartitionByRange(files, *keys) if files else out.repartitionByRange(*keys)
        out = parts.sortWithinPartitions(*keys)  # without ``files`` the data's size decides (adaptive coalescing)
    w = out.write.mode("overwrite")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)
    if order:
        write_manifest(df.sparkSession, path)


MANIFEST = "_manifest"  # hidden from readers of the folder, as its name begins with an underscore


def write_manifest(spark: SparkSession, path: str, folders: str | None = None) -> None:
    """(file, rows, first_line) of the part files below ``path``: rows as read back, lines numbered over the files of a directory in
    name order. One row a file. ``folders`` is the pattern of the folders they are in, if Spark wouldn't look there."""
    below = f"{path.rstrip('/')}/{folders}" if folders else path
    each = spark.read.option("lineSep", "\n").text(below).groupBy(F.col("_metadata.file_path").alias("file"))
    counts = each.agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy(F.regexp_extract("file", "^(.*)/[^/]*$", 1)).orderBy("file")
    first = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("first_line", first).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{MANIFEST}")


def write_router_files(df: DataFrame, path: str, *, domain: str = "domain", order: Sequence[str], suffix: str = "-router.jsonl",
                       files: int | None = None) -> None:
    """One ``<domain><suffix>`` for each value of ``domain``, a folder of part files in order (Spark's readers take it as
    one file), with a manifest. The folders are renamed once the job has committed: one call a domain."""
    write_jsonl(df, path, order=order, partition_by=domain, files=files)
    spark = df.sparkSession
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(top):
        name = status.getPath().getName()
        if name.startswith(f"{domain}="):
            system.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(top, name.split("=", 1)[1] + suffix))
    write_manifest(spark, path, f"*{suffix}")


def _sorted_shards(ranked: DataFrame) -> DataFrame:
    """Rows range-partitioned by (shard, rank): a shard is one or more files whose name order is its row order."""
    return ranked.repartitionByRange("shard", "rank").sortWithinPartitions("shard", "rank").drop("rank")


def write_shards(df: DataFrame, path: str, num_shards: int, order: Sequence[str] | str, *,
                 fmt: str = "parquet", strided: bool = False) -> None:
    """``num_shards`` contiguous (or strided) shards, one directory ``shard=i`` each."""
    s = contiguous_chunks(df, num_shards, order, chunk_col="shard", strided=strided)
    _sorted_shards(s).write.mode("overwrite").partitionBy("shard").format(fmt).save(path)


def write_line_shards(df: DataFrame, path: str, order: Sequence[str] | str, *, min_shards: int = 128) -> None:
    """A10: ``floor(n/min_shards)`` lines per shard, gzip JSON lines, one directory per shard."""
    s = line_shards(df, min_shards, order)
    (_sorted_shards(s)
     .write.mode("overwrite").option("compression", "gzip").partitionBy("shard").json(path))


# Result-record fields per inference mode.
RESULT_FIELDS = {
    "generate": ["completion", "prompt", "label"],
    "logits": ["completion", "highest_token", "logits", "label", "generated", "prompt"],
    "hidden_state": ["hidden_state", "label", "prompt"],
    "get_loss": ["loss", "perplexity", "prompt", "label"],
    "router": ["prompt", "token_index", "router_logits"],
}


def write_results(df: DataFrame, path: str, mode: str, *, partition_by: str | None = None) -> None:
    """Result JSONL with the mode's fields (optionally one directory per ``partition_by`` value)."""
    if mode not in RESULT_FIELDS:
        raise ValueError(f"unknown result mode {mode!r}")
    cols = RESULT_FIELDS[mode] + ([partition_by] if partition_by else [])
    w = df.select(*cols).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def write_per_evaluator(df: DataFrame, path: str, *, evaluator: str = "evaluator") -> None:
    """One output directory per evaluator label."""
    # rebalanced: a large label is split over several files, small ones share a task
    df.hint("rebalance", evaluator).write.mode("overwrite").partitionBy(evaluator).json(path)


def evaluator_samples(df: DataFrame, *, evaluator: str = "evaluator", prompt: str = "prompt",
                      order: str = "order_key") -> DataFrame:
    """The first prompt of each evaluator (``min_by``; a bounded aggregate per group)."""
    return df.groupBy(evaluator).agg(F.min_by(prompt, order).alias("sample_prompt"))
