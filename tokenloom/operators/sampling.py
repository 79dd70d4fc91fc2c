"""Balanced sampling (F2, F3), concatenation.

The n first rows of a class in seeded order are found by a threshold and not by sorting: the order keys are counted in
histograms of ``2**LEVEL_BITS`` buckets a class, only the bucket in which the n-th row falls is split again, until it
holds few rows or one value; then a filter keeps what lies below. No class meets in one task and no window runs over one, whatever n is. The
keys (class and four longs a row) are written once, and at most a row a class and bucket reaches the driver.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import order_key
from tokenloom.session import stage


LEVEL_BITS, KEY_BITS = 12, 60


def _order_longs() -> dict[str, Column]:
    """``order_key`` (hexadecimal) and a hash of the row as non-negative longs that order alike; together they tell rows apart."""
    part = lambda at: F.conv(F.substring("order_key", at, KEY_BITS // 4), 16, 10).cast("long")
    return {"_k0": part(1), "_k1": part(16), "_k2": F.shiftrightunsigned("_tb", 64 - KEY_BITS)}


COLUMNS = ("_k0", "_k1", "_k2")
FEW = 4096  # rows of a bucket whose keys are looked at one by one


def _within(c, s: dict) -> Column:
    """Rows of class ``c`` in the bucket that state ``s`` has come to."""
    on = F.col("_c") == F.lit(c)
    for name, value in s["fixed"]:
        on = on & (F.col(name) == value)
    return on & F.col(s["column"]).between(s["lo"], s["lo"] + (1 << s["bits"]) - 1)


def _first_rows(keys: DataFrame, classes: Sequence, n: int, strict: bool) -> dict:
    """Class -> ``bounds`` (column, value) and ``left``: a row is in if its longs lie below the bounds (first column first), and
    of the rows that equal all of them ``left`` are in. A class of at most n rows is left out: all its rows are in.

    A round counts the open classes' buckets in one job. A bucket of few rows is settled from its keys, others are split again.
    """
    state: dict = {}

    def narrowed(c, s: dict, hist: list[tuple[int, int]]) -> None:
        s["bits"] -= LEVEL_BITS
        for bucket, k in sorted(hist):
            if k > s["left"]:
                s["lo"], s["rows"] = bucket << s["bits"], k
                return
            s["left"] -= k
        raise AssertionError(f"class {c} lost rows between two reads")

    def counts(bucket: Column, where: Column) -> dict:
        per: dict = {}
        for r in keys.where(where).groupBy("_c", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            per.setdefault(r["_c"], []).append((r["b"], r["n"]))  # at most 2^LEVEL_BITS rows a class
        return per

    for c, hist in counts(F.shiftright("_k0", KEY_BITS - LEVEL_BITS), F.lit(True)).items():
        total = sum(k for _, k in hist)
        state[c] = {"total": total, "left": n, "fixed": [], "column": "_k0", "lo": 0, "bits": KEY_BITS}
        if total > n:
            narrowed(c, state[c], hist)
    if strict and any(c not in state or state[c]["total"] < n for c in classes):
        raise ValueError(f"a class has fewer than {n} rows: { {c: s['total'] for c, s in state.items()} }")
    state = {c: s for c, s in state.items() if s["total"] > n}
    while open_ := {c: s for c, s in state.items() if "bounds" not in s}:
        few = {c: s for c, s in open_.items() if s["rows"] <= FEW}
        if few:
            where = functools.reduce(operator.or_, [_within(c, s) for c, s in few.items()])
            near: dict = {}
            for r in keys.where(where).select("_c", *COLUMNS).collect():
                near.setdefault(r["_c"], []).append(tuple(r[x] for x in COLUMNS))
            for c, s in few.items():
                rows = sorted(near[c])
                first_out = rows[s["left"]]
                s["bounds"], s["left"] = list(zip(COLUMNS, first_out)), s["left"] - rows.index(first_out)
        many = {c: s for c, s in open_.items() if c not in few}
        for s in many.values():
            if not s["bits"]:  # one value: the next column decides, or the rows are alike in all columns
                s["fixed"].append((s["column"], s["lo"]))
                if len(s["fixed"]) == len(COLUMNS):
                    s["bounds"] = s["fixed"]
                else:
                    s |= {"column": COLUMNS[len(s["fixed"])], "lo": 0, "bits": KEY_BITS}
        many = {c: s for c, s in many.items() if "bounds" not in s}
        if many:
            bucket, where = F.lit(None).cast("long"), F.lit(False)
            for c, s in many.items():
                bucket = F.when(F.col("_c") == F.lit(c), F.shiftright(s["column"], s["bits"] - LEVEL_BITS)).otherwise(bucket)
                where = where | _within(c, s)
            for c, hist in counts(bucket, where).items():
                narrowed(c, many[c], hist)
    return state


def _top_n(df: DataFrame, cls: str, classes: Sequence, n: int, strict: bool) -> DataFrame:
    # Rows whose seeded keys collide are ordered by a hash of the whole row, so only
    # identical rows (interchangeable) can tie and a re-run task picks the same sample.
    if n < 1:
        raise ValueError("n must be >= 1")
    df = df.withColumn("_tb", F.xxhash64(*[F.col(c) for c in df.columns])).withColumns(_order_longs())
    keys = stage(df.select(F.col(cls).alias("_c"), "_k0", "_k1", "_k2"), "balanced-keys")
    state = _first_rows(keys, classes, n, strict)
    taken, tied = F.lit(True), []
    for c, s in state.items():
        below, same = F.lit(False), F.lit(True)
        for name, value in s["bounds"]:
            below = below | (same & (F.col(name) < value))
            same = same & (F.col(name) == value)
        on = F.col(cls) == F.lit(c)
        taken = F.when(on, below).otherwise(taken)
        if s["left"]:
            tied.append(df.where(on & same).limit(s["left"]))  # rows alike in all columns: any of them
    out = df.where(taken)
    for t in tied:
        out = out.unionByName(t)
    return out.drop("_tb", "_k0", "_k1", "_k2")


def binary_balanced(df: DataFrame, predicate: Column, *, n: int, seed, key: Sequence[str],
                    strict: bool = True) -> DataFrame:
    """n rows where the predicate is false and n where it is true, in seeded order.

    Adds ``label`` (the predicate value) and ``order_key``; NULL predicates count as false.
    ``strict`` fails the job when a class has fewer than n rows.
    """
    x = df.withColumn("label", F.coalesce(predicate, F.lit(False))).withColumn("order_key", order_key(seed, *key))
    return _top_n(x, "label", [False, True], n, strict)


def nary_balanced(df: DataFrame, predicates: Sequence[Column], *, n: int, seed, key: Sequence[str],
                  strict: bool = True) -> DataFrame:
    """n rows per predicate; predicates may overlap, so a row may appear once per matching class.

    Matching class ids are exploded inside the row, then ranked per class.
    """
    ids = F.filter(F.array(*[F.when(p, F.lit(i)) for i, p in enumerate(predicates)]), lambda c: c.isNotNull())
    x = df.withColumn("class_id", F.explode(ids)).withColumn("order_key", order_key(seed, *key))
    return _top_n(x, "class_id", range(len(predicates)), n, strict)


def concat_tables(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """G1: UNION ALL by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def concat_parts(df: DataFrame, order: Sequence[str] = ("chunk", "row")) -> DataFrame:
    """Part files in chunk order (only when a consumer needs the order)."""
    return df.orderBy(*order)
