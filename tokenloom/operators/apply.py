"""Apply / UDF surface: I1 batch apply, I2/I3 apply with a dead-letter table, I5 batch scoring.

I4 (retry a failed chunk) is Spark's own task retry (``spark.task.maxFailures``):
a failed task is re-run from its input split, and successful tasks run once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.operators.checks import require_columns
from tokenloom.session import checkpoint_dir, scratch

DEAD_LETTER_TYPE = T.StructType([
    T.StructField("out", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("message", T.StringType()),
])


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """Apply a pandas-DataFrame -> pandas-DataFrame function to every Arrow batch (no shuffle)."""
    def run(it):
        for pdf in it:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def apply_per_shard(df: DataFrame, shard: str, fn: Callable, schema) -> DataFrame:
    """I1 when shard identity matters: one call per shard group (shards must be bounded in size)."""
    return df.groupBy(shard).applyInPandas(fn, schema)


def error_class(e: BaseException) -> str:
    """Error names of the dead-letter table."""
    if isinstance(e, json.JSONDecodeError):
        return "JSONDecodeError"
    if isinstance(e, OSError):
        return "IOError"
    if isinstance(e, (KeyError, IndexError)):
        return type(e).__name__
    return "UnhandledException"


def apply_with_errors(df: DataFrame, fn: Callable, value: str, *, index: str = "index",
                      wrap: bool = True) -> DataFrame:
    """Run ``fn`` on each value in Arrow batches; output ``index, out, error, message``.

    ``out`` is ``json.dumps(fn(v))`` (I2 stores it under ``{"out": ...}``; ``wrap=False``
    gives the bare result and, like I3, ``error`` = the message text only).
    Exceptions never fail the task; they become error rows.
    """
    @F.pandas_udf(DEAD_LETTER_TYPE)
    def run(values: pd.Series) -> pd.DataFrame:
        outs, errs, msgs = [], [], []
        for v in values.tolist():
            try:
                outs.append(json.dumps(fn(v)))
                errs.append(None)
                msgs.append(None)
            except Exception as e:  # noqa: BLE001 - every failure becomes a dead-letter row
                outs.append(None)
                errs.append(error_class(e) if wrap else str(e))
                msgs.append(str(e) if wrap else None)
        return pd.DataFrame({"out": outs, "error": errs, "message": msgs})

    return df.select(F.col(index).alias("index"), run(F.col(value)).alias("_r")).select("index", "_r.*")


_SHARED: dict[tuple, str] = {}


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and modification times of all files below ``paths``, as one value (no contents are read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    one = F.xxhash64("path", "length", "modificationTime")
    return repr(files.agg(F.count(F.lit(1)), F.bit_xor(one), F.sum("length")).first())


def split_dead_letter(results: DataFrame, *, stage: bool = True, shared_as: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows ``(index, out)`` and error rows ``(index, error, message)`` of one UDF evaluation.

    With ``stage=True`` the results are written once to the shared checkpoint folder, in one directory an outcome, and each
    output is a read of its directory alone, so the UDF runs exactly once and a
    lost executor re-reads files instead of re-running the UDF. ``shared_as`` names an evaluation (a fingerprint of its input and
    the name of the function): later calls of the session with the same name read what the first one wrote.
    """
    ok = F.col("error").isNull()
    if not stage:
        return results.where(ok).select("index", "out"), results.where(~ok).select("index", "error", "message")
    spark = results.sparkSession
    key = (spark.sparkContext.applicationId, checkpoint_dir(spark), *shared_as) if shared_as else None
    path = _SHARED.get(key) if key else None
    if path is None:
        path = scratch(spark, "dead-letter")
        results.withColumn("failed", ~ok).write.partitionBy("failed").parquet(path)
        if key:
            _SHARED[key] = path
    back = spark.read.schema(results.withColumn("failed", F.lit(True)).schema).parquet(path)
    return back.where(~F.col("failed")).select("index", "out"), back.where("failed").select("index", "error", "message")


SCORE_TYPES = {
    "generate": "completion string",
    "logits": "completion boolean, highest_token int, logits array<double>, generated string",
    "hidden_state": "hidden_state array<double>",
    "get_loss": "loss double, perplexity double",
}

# Columns a mode needs beside the prompt.
SCORE_NEEDS = {"get_loss": ("target_mask",)}


def score(df: DataFrame, fn: Callable[[list[str]], list[dict]], mode: str, *, prompt: str = "prompt",
          label: str | None = "label", keep: list[str] | tuple = ()) -> DataFrame:
    """Batch scoring with a user callable; fixed output struct per mode, ``prompt``/``label`` carried.

    ``fn`` receives a list of prompts (one Arrow batch) and returns one dict per
    prompt with the mode's fields; in mode ``get_loss`` it also receives the list of
    target masks (column ``target_mask``, required). Unknown modes and missing columns fail at plan time.
    ``keep`` carries extra key columns through.
    """
    if mode not in SCORE_TYPES:
        raise ValueError(f"unknown inference mode {mode!r}; expected one of {sorted(SCORE_TYPES)}")
    needs = SCORE_NEEDS.get(mode, ())
    require_columns(df, [prompt, *keep, *needs], f"{mode} input")
    schema = T._parse_datatype_string(SCORE_TYPES[mode])
    names = [f.name for f in schema.fields]

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            cols = cols if isinstance(cols, tuple) else (cols,)  # one column comes as a bare Series
            s = cols[0]
            rows = fn(*[c.tolist() for c in cols])
            if len(rows) != len(s):
                raise ValueError("scorer must return one result per prompt")
            yield pd.DataFrame({n: [r.get(n) for r in rows] for n in names})

    lab = F.col(label) if label and label in df.columns else F.lit(None).alias("label")
    return df.select(*keep, F.col(prompt).alias("prompt"), lab.alias("label"),
                     run(*[F.col(c) for c in (prompt, *needs)]).alias("_s")).select(*keep, "prompt", "label", "_s.*")
