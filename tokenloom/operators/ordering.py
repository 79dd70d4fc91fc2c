"""Stable order without a single-partition window.

E2 prefix_sum/global_rank (range buckets over the whole order tuple + prefix sums of the bucket totals), E3
named_splits (+ D10 capacity check), E4 batches, E5 contiguous/strided chunks, A10 line shards, E8 seeded order key,
F5 first_n.

Buckets are the partitions of a range partitioning by the full order tuple (bounds sampled from the data), so they hold
about equally many rows for dense or sparse numbers, strings with a common head and repeating keys alike. The
bucket number is written with the rows to the shared checkpoint folder: a recomputed task can't disagree about it.
NULL keys sort first, like any other value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import col_, order_key
from tokenloom.operators.checks import assert_true, require_columns
from tokenloom.session import stage

#: Rows of a bucket: small inputs get buckets of MIN_ROWS until every shuffle partition has one, large ones of MAX_ROWS.
MIN_ROWS, MAX_ROWS = 1 << 12, 1 << 20


def bucket_count(df: DataFrame, rows: int) -> int:
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // MAX_ROWS), min(slots, -(-rows // MIN_ROWS)))


def range_buckets(df: DataFrame, keys: Sequence[str], ties: bool, buckets: int | None = None) -> DataFrame:
    """``df`` staged with ``__bucket``: consecutive ranges of ``keys``, about equally large.

    ``ties`` adds a hash of the row and its place in the input to the range keys, so rows that share a key (even
    identical ones) are dealt to many buckets; without it they stay together.
    """
    x = df
    if ties:
        plain = [c for c, t in df.dtypes if "map<" not in t]
        x = x.withColumns({"__tie": F.xxhash64(*[F.col(f"`{c}`") for c in plain]), "__place": F.monotonically_increasing_id()})
    keys = [*keys, *(["__tie", "__place"] if ties else [])]
    n = buckets or bucket_count(df, df.count())
    return stage(x.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys])
                 .withColumn("__bucket", F.spark_partition_id()), "ordered")


def prefix_sum(df: DataFrame, order: Sequence[str] | str, value: Column | str | None = None, *,
               partition: Sequence[str] = (), start_col: str = "start", total_col: str | None = "n_total",
               ties: bool = False, buckets: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` (default 1 per row) under ``order``; ``partition`` restarts it per group.

    Plan: range buckets (see above); a window inside each bucket; bucket totals (one row per bucket and group) whose
    own running sum is each bucket's offset; a join back on the bucket. No task sorts more than a bucket and only the
    totals meet in one task.

    Rows that share the order key fail the job, because the sum would depend on the physical order; with ``ties`` they are
    ordered by a hash of the whole row instead, so only identical (interchangeable) rows can tie.
    """
    order = [order] if isinstance(order, str) else list(order)
    part = list(partition)
    require_columns(df, order + part, "prefix_sum input")
    v = F.lit(1).cast("long") if value is None else col_(value).cast("long")
    x = range_buckets(df.withColumn("__v", v), part + order, ties, buckets)
    by = [F.col(c) for c in order] + ([F.col("__tie"), F.col("__place")] if ties else [])
    w = Window.partitionBy("__bucket", *part).orderBy(*by)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = x.groupBy("__bucket", *part).agg(F.sum("__v").alias("__bn"))
    upto = Window.partitionBy(*part).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offs = totals.select(F.col("__bucket").alias("__b"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(part)],
                         (F.sum("__bn").over(upto) - F.col("__bn")).alias("__off"),
                         F.sum("__bn").over(Window.partitionBy(*part) if part else Window.partitionBy(F.lit(1)))
                         .alias("__tot"))
    x = x.withColumn("__ls", F.sum("__v").over(run) - F.col("__v"))
    if not ties:
        key = F.struct(*[F.col(c) for c in order])
        x = x.withColumn("__prev", F.lag(key).over(w))
        x = x.where(assert_true(F.col("__prev").isNull() | ~F.col("__prev").eqNullSafe(key),
                                f"order key {order} is not unique; add tie-breaking columns or ties=True")).drop("__prev")
    on = F.col("__bucket") == F.col("__b")
    for i, c in enumerate(part):
        on = on & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    out = x.join(offs, on).withColumn(start_col, F.col("__off") + F.col("__ls"))
    if total_col:
        out = out.withColumn(total_col, F.col("__tot"))
    return out.select(*df.columns, start_col, *([total_col] if total_col else []))


def global_rank(df: DataFrame, order: Sequence[str] | str, *, rank_col: str = "rank",
                total_col: str | None = "n_total", ties: bool = False, buckets: int | None = None) -> DataFrame:
    """1-based rank of every row under ``order``, plus the row count."""
    out = prefix_sum(df, order, None, start_col="__start", total_col=total_col, ties=ties, buckets=buckets)
    return out.withColumn(rank_col, F.col("__start") + 1).drop("__start")


def named_splits(df: DataFrame, sizes: Mapping[str, float], order: Sequence[str] | str, *,
                 split_col: str = "split", ties: bool = False) -> DataFrame:
    """E3 + D10: consecutive ranges of the order, one per split name, in the given order.

    ``sizes`` values are row counts (int) or fractions of the row count (float,
    ``floor(f * n)``). Rows after the last range get a NULL split (kept, not dropped).
    Asking for more rows than exist fails the job.
    """
    if not sizes:
        raise ValueError("sizes must name at least one split")
    fractional = [isinstance(v, float) for v in sizes.values()]
    if any(fractional) and not all(fractional):
        raise ValueError("sizes must be all counts or all fractions")
    if all(fractional) and sum(sizes.values()) > 1.0 + 1e-12:
        raise ValueError(f"fractions {dict(sizes)} add up to more than 1")
    r = global_rank(df, order, rank_col="_rank", total_col="_n", ties=ties)
    n = F.col("_n")
    hi = F.lit(0).cast("long")
    case = None
    bounds = []
    for name, v in sizes.items():
        size = F.floor(F.lit(float(v)) * n).cast("long") if isinstance(v, float) else F.lit(int(v)).cast("long")
        hi = hi + size
        bounds.append((name, hi))
    for name, h in bounds:
        case = (F.when(F.col("_rank") <= h, F.lit(name)) if case is None
                else case.when(F.col("_rank") <= h, F.lit(name)))
    if not any(fractional):  # checked against an aggregate, so an empty input fails too
        wanted = sum(int(v) for v in sizes.values())
        have = df.agg(F.count(F.lit(1)).alias("__have")).where(
            assert_true(F.col("__have") >= wanted, f"sum of partitions {dict(sizes)} is greater than dataset size"))
        r = r.unionByName(have.where("__have < 0").select(*[F.lit(None).cast(t).alias(c) for c, t in r.dtypes]))
    return r.withColumn(split_col, case).drop("_n").withColumnRenamed("_rank", "rank")


def batches(df: DataFrame, size: int, order: Sequence[str] | str, *, batch_col: str = "batch_id",
            ties: bool = False) -> DataFrame:
    """Fixed-size consecutive batches ``rows[i:i+size]`` under the order."""
    if size < 1:
        raise ValueError("batch size must be >= 1")
    r = global_rank(df, order, total_col=None, ties=ties)
    return r.withColumn(batch_col, F.floor((F.col("rank") - 1) / size).cast("long"))


def contiguous_chunks(df: DataFrame, parts: int, order: Sequence[str] | str, *, chunk_col: str = "chunk",
                      strided: bool = False, ties: bool = False) -> DataFrame:
    """E5: ``chunk_size = n div parts + 1`` if ``n >= parts`` else 1; chunk = (rank-1) div chunk_size.

    ``strided=True`` gives ``(rank-1) mod parts`` instead (the other ``shard(n, i)`` layout).
    """
    if parts < 1:
        raise ValueError("parts must be >= 1")
    r = global_rank(df, order, total_col="_n", ties=ties)
    if strided:
        c = F.pmod(F.col("rank") - 1, F.lit(parts))
    else:
        size = F.when(F.col("_n") >= parts, F.floor(F.col("_n") / parts) + 1).otherwise(F.lit(1))
        c = F.floor((F.col("rank") - 1) / size)
    return r.withColumn(chunk_col, c.cast("long")).drop("_n")


def line_shards(df: DataFrame, min_shards: int, order: Sequence[str] | str, *, shard_col: str = "shard",
                ties: bool = False) -> DataFrame:
    """A10: ``split -l floor(n/min_shards)``: shard = (rank-1) div max(1, n div min_shards).

    The shard count is ``ceil(n / floor(n/min_shards))`` so ``min_shards`` is a minimum.
    """
    r = global_rank(df, order, total_col="_n", ties=ties)
    per = F.greatest(F.lit(1), F.floor(F.col("_n") / min_shards))
    return r.withColumn(shard_col, F.floor((F.col("rank") - 1) / per).cast("long")).drop("_n")


def seeded_order(df: DataFrame, seed, keys: Sequence[str], *, col: str = "order_key") -> DataFrame:
    """Deterministic shuffle key ``md5('seed:key...')``; sort by it to shuffle."""
    return df.withColumn(col, order_key(seed, *keys))


def first_n(df: DataFrame, n: int, order: Sequence[str] | str) -> DataFrame:
    """the first n rows under the order (TakeOrderedAndProject, a bounded top-n)."""
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*[col_(c) for c in order]).limit(n)
