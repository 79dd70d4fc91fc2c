"""Token-count roll-ups: A7 sidecar counts, D3 directory totals, D4 composition roll-up,
D9 training steps, A13 composition report, H17 path columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import path_clean, path_parent, path_stem


def sidecar_token_counts(spark, pattern: str) -> DataFrame:
    """Per-file token count from headerless gz CSV sidecars: column 1 of the last row.

    A gz file is one split, so ``monotonically_increasing_id`` numbers its rows in order. Empty files have no row.
    """
    df = (spark.read.schema("c0 long, n long").option("header", "false").csv(pattern)
          .select(F.col("_metadata.file_path").alias("file_path"), "n", F.monotonically_increasing_id().alias("at")))
    return df.groupBy("file_path").agg(F.max_by("n", "at").cast("long").alias("tokens"))


def directory_totals(per_file: DataFrame, *, tokens: str = "tokens") -> DataFrame:
    """D3: sum of per-file counts per parent directory."""
    parent = path_parent("file_path")
    return per_file.groupBy(parent.alias("directory")).agg(F.sum(tokens).cast("long").alias("total_tokens"))


def composition_rollup(df: DataFrame, *, category: str, subfolder: str, tokens: str = "n_tokens",
                       data_path: str | None = None) -> DataFrame:
    """D4 + A13: ``(data_path, category, subfolder, total_tokens)`` with category subtotals and a grand total.

    ``rollup`` yields NULL in rolled-up columns; ``level`` says which (0 detail, 1 category, 2 total).
    """
    r = (df.rollup(F.col(category).alias("category"), F.col(subfolder).alias("subfolder"))
         .agg(F.sum(tokens).cast("long").alias("total_tokens"),
              F.grouping_id().cast("int").alias("level")))
    return r.select(F.lit(data_path).cast("string").alias("data_path"), "category", "subfolder", "total_tokens",
                    F.when(F.col("level") == 0, 0).when(F.col("level") == 1, 1).otherwise(2).alias("level"))


def training_steps(counts: DataFrame, *, n: str = "n_rows", batch_size: int, grad_accum: int, epochs: int
                   ) -> DataFrame:
    """``ceil(n / (batch * accumulation)) * epochs``."""
    if batch_size < 1 or grad_accum < 1 or epochs < 0:
        raise ValueError("batch_size and grad_accum must be >= 1, epochs >= 0")
    return counts.withColumn("steps", (F.ceil(F.col(n) / F.lit(batch_size * grad_accum)) * epochs).cast("long"))


def path_columns(df: DataFrame, path: str) -> DataFrame:
    """Parent directory, base name before the first dot, cleaned path."""
    return df.withColumns({"parent": path_parent(path), "stem": path_stem(path), "clean": path_clean(path)})


def write_report(df: DataFrame, out: str, *, cols: Sequence[str] = ("data_path", "category", "subfolder",
                                                                   "total_tokens")) -> None:
    """A13 sink: one small CSV with a header, detail rows only (the report is tiny: one row per category x subfolder)."""
    if "level" in df.columns:
        df = df.where("level = 0")
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(out)
