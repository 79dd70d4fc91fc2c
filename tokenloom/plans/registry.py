"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the DuckDB-runnable oracle over the same tables."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A driver table. One that its scan splits into fewer parts than there are task slots (files of few row groups) is dealt over
    the slots by a hash of the whole row; a scan that fills the slots is left as it is, whatever its size."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    if not spread or df._jdf.queryExecution().toRdd().getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *df.columns)
