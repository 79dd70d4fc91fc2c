"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.session import checkpoint_dir

#: A word: anything but the six ASCII white-space characters (the same in Java, DuckDB and Python's bytes.split).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows a lookup table may have and still be broadcast; each row is a key and a few numbers.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    checkpoint_dir(spark)  # sets a folder for local sessions that have none
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends in files every
    executor can reach, so a lost executor costs a re-read and not the upstream work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """Add to each row of ``big`` the row of ``small`` (one row a key, a staged table) with its key; nulls match.

    ``small`` is counted first: up to BROADCAST_ROWS rows it is broadcast, beyond that both sides are
    shuffled on the key and a salt, with ``small`` repeated once a salt, so a key that holds a third of
    ``big`` still goes to ``salts`` tasks. The key column appears once, from ``big``.
    """
    right = small.withColumnRenamed(key, "__key")
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), same(big[key], right["__key"]), how).drop("__key")
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in big.dtypes if not t.startswith("map")]),
                                           F.lit(salts)))
    right = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long"))
    return left.join(right, same(left[key], right["__key"]) & (left["__salt"] == right["__s"]),
                     how).drop("__key", "__salt", "__s")


#: A chunk of rows that were read one after the other: 4096 of a partition.
CHUNK_BITS = 12


def read_chunk() -> Column:
    """Number of the chunk a row is read in; stage it with the row, for another read may cut the chunks otherwise."""
    return F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)


def copy_numbers(rows: DataFrame, same: list[str], chunk: str, number: str) -> DataFrame:
    """``rows`` (staged) with ``number``: 0, 1, ... among the rows that agree in ``same``; null equals null.

    They are counted by chunk, and a row's number is that of its chunk's first row plus its place there, so the rows of a
    group that holds a third of the table never meet in one task. A window sees a chunk's rows or one row a chunk.
    """
    earlier = F.sum("__n").over(Window.partitionBy(*same).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    chunks = rows.groupBy(*same, chunk).agg(F.count(F.lit(1)).alias("__n")).withColumn("__earlier", earlier)
    chunks = chunks.filter("__earlier > 0").select(*[F.col(c).alias(f"__{c}") for c in (*same, chunk)], "__earlier")
    here = F.row_number().over(Window.partitionBy(*same, chunk).orderBy(F.lit(1))) - 1
    on = F.lit(True)
    for c in (*same, chunk):
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    got = rows.withColumn("__here", here).join(chunks, on, "left")
    return got.select(*rows.columns, (F.col("__here") + F.coalesce("__earlier", F.lit(0))).cast("long").alias(number))
