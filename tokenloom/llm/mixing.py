"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Each source's token target is a number of whole passes over the source plus a budget for a last, partial
pass. A document's place in the partial pass is a 60-bit hash of its key, so the pass is "every document
whose hash lies below the source's cut". The cut comes from histograms: tokens are summed by (source, hash
bucket), the bucket in which the budget runs out is found from a running sum over at most 4096 buckets, and
only that bucket is split again, until it holds one hash value. If several rows share it (a repeated or a
missing key), the group is cut in the same way by a 60-bit hash of the whole row, and rows equal even there by the place at
which they were read, so in the end a single row is taken or not. No document is ever sorted, and the
same input gives the same mix on every run (of rows equal in all columns, which are interchangeable, the same number).

Defined cases: null or empty texts have size 0 and are taken like any other; a null source is a source of
its own, last in order; rows with an equal key have an equal hash, and a null key counts as the empty string; rows equal in
all columns are cut singly; an empty table gives an empty mix. The document at the cut is taken if that
brings the source nearer to its target. Other columns are read for the hash of the row only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import WORD, lookup_join, staged

HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: str) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(key: str) -> Column:
    """The first 60 bits of the key's MD5 as a non-negative long."""
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """60 bits of a hash of all columns as a non-negative long; a null differs from a column left out."""
    cols = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    return F.shiftrightunsigned(F.xxhash64(*cols, *[c.isNull() for c in cols]), 64 - HASH_BITS)


def sized(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, h, r, m) of every document, staged: the text is read once. ``m`` is the place it was read at."""
    return staged(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
                              key_hash(key).alias("h"), row_hash(docs).alias("r"), F.monotonically_increasing_id().alias("m")),
                  "mix-sizes")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt out by weight, no source above ``most`` times its own.

    Sources by code point (null last) get ``weights`` in turn. A source that reaches its bound gives the
    excess back to the others by weight: with the sources in the order bound / weight, those before
    the first one for which the level (rest of the budget / rest of the weights) is within its bound are full.
    The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("source", "source_size", place.alias("i"))
    per = per.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("i") % len(weights)))
    per = per.withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    per = per.withColumn("ratio", F.col("bound") / F.col("w"))
    order = Window.orderBy("ratio", "i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    rest_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (budget - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / rest_w
    per = per.withColumn("level", level).withColumn("k", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))
    per = per.withColumn("final", F.min(fits).over(everything)["level"])
    return per.select("source", "source_size", F.least("bound", F.coalesce(F.col("w") * F.col("final"), F.col("bound")))
                      .alias("target"))


def _boundary(sizes: DataFrame, state: DataFrame, column: str) -> DataFrame:
    """(source, rest, cut, tie) for a ``state`` of (source, rest): the value of ``column`` below which rows are taken.

    If the last value holds more than one row, it is the ``tie`` and the cut, and ``rest`` is what is left
    for it. Each level is one pass over the staged rows of the open buckets and one row a source of state;
    at most five levels, fewer once every open bucket holds a single value.
    """
    state = staged(state.select("source", "rest", F.lit(0).cast("long").alias("lo"), F.lit(None).cast("long").alias("cut"),
                                F.lit(None).cast("long").alias("tie")), "mix-cuts")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        width = 1 << (shift + LEVEL_BITS)
        open_ = state.filter("cut IS NULL").select("source", "lo", "rest")
        rows = lookup_join(sizes.select("source", "size", F.col(column).alias("h")), open_, "source")
        rows = rows.filter((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + F.lit(width)))
        hist = rows.groupBy("source", "rest", F.shiftright("h", shift).alias("b")).agg(
            F.sum("size").alias("size"), F.min("h").alias("h0"), F.max("h").alias("h1"), (F.count(F.lit(1)) == 1).alias("alone"))
        w = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("size").over(w)).filter(F.col("upto") > F.col("rest"))
        first = hist.groupBy("source").agg(F.min(F.struct("b", "size", "upto", "h0", "h1", "alone", "rest")).alias("f"))
        left = F.col("f.rest") - (F.col("f.upto") - F.col("f.size"))
        taken = (F.col("f.alone") & (F.col("f.size") / 2 <= left)).cast("long")
        single = F.col("f.h0") == F.col("f.h1")
        first = first.select("source", F.lit(True).alias("found"), F.shiftleft("f.b", shift).alias("lo2"),
                             left.alias("rest2"), F.when(single, F.col("f.h0") + taken).alias("cut2"),
                             F.when(single & ~F.col("f.alone"), F.col("f.h0")).alias("tie2"))
        first = staged(first, "mix-bucket")
        state = lookup_join(state, first, "source", "left")
        whole = F.when(F.col("found").isNull(), F.lit(1 << HASH_BITS))  # the budget covers all that is left
        state = staged(state.select(
            "source", F.coalesce("rest2", "rest").alias("rest"), F.coalesce("lo2", "lo").alias("lo"),
            F.coalesce("cut", "cut2", whole).alias("cut"), F.coalesce("tie", "tie2").alias("tie")), "mix-cuts")
        if state.filter("cut IS NULL").isEmpty():
            break
    return state.select("source", "rest", "cut", "tie")


def cuts(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, cut, tie, tie_cut, same, same_rest), staged: whole passes, and the hash below which
    one more is made. Of the rows whose hash is ``tie``, those with a row hash below ``tie_cut`` get it as well, and of
    those whose row hash is ``same`` as many as make up ``same_rest`` words (see :func:`singly`)."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("passes", passes).withColumn("rest", F.col("target") - passes * F.col("source_size"))
    state = staged(state, "mix-goals")
    top = _boundary(sizes, state.select("source", "rest"), "h")
    ties = top.filter("tie IS NOT NULL").select("source", "tie", "rest")
    out = lookup_join(state.drop("rest"), top.drop("rest"), "source")
    if ties.isEmpty():
        none = [F.lit(None).cast(t).alias(c) for c, t in (("tie_cut", "long"), ("same", "long"), ("same_rest", "double"))]
        return staged(out.select(*_STATE, "cut", "tie", *none), "mix-bounds")
    tied = lookup_join(sizes, ties.select("source", "tie"), "source").filter("h = tie")
    low = _boundary(tied, ties.select("source", "rest"), "r").select(
        "source", F.col("cut").alias("tie_cut"), F.col("tie").alias("same"), F.col("rest").alias("same_rest"))
    out = lookup_join(out, low, "source", "left").select(*_STATE, "cut", "tie", "tie_cut", "same", "same_rest")
    return staged(out, "mix-bounds")


_STATE = ("source", "source_size", "target", "passes")


def singly(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """:func:`cuts` with ``same_cut``: the place ``m`` below which the equal rows at the cut are taken; rows as in :func:`sized`,
    of which only those equal ones matter."""
    open_ = bounds.filter("same IS NOT NULL")
    if open_.isEmpty():
        return bounds.withColumn("same_cut", F.lit(None).cast("long"))
    equal = lookup_join(rows, open_.select("source", "tie", "same"), "source").filter("h = tie AND r = same")
    low = _boundary(equal, open_.select("source", F.col("same_rest").alias("rest")), "m")
    return staged(lookup_join(bounds, low.select("source", F.col("cut").alias("same_cut")), "source", "left"), "mix-bounds")


def _times() -> Column:
    """How often a row (h, r, m) is taken that has its source's cuts beside it."""
    same = F.coalesce((F.col("r") == F.col("same")) & (F.col("m") < F.col("same_cut")), F.lit(False))
    tied = F.coalesce((F.col("h") == F.col("tie")) & ((F.col("r") < F.col("tie_cut")) | same), F.lit(False))
    return F.col("passes") + ((F.col("h") < F.col("cut")) | tied).cast("long")


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(key, source, size, source_size, target, times) for every row: how often the mix takes each document."""
    sizes = sized(docs, key=key, source=source, text=text)
    bounds = singly(sizes, cuts(sizes, targets(sizes, weights=weights, share=share, most=most)))
    out = lookup_join(sizes, bounds, "source")
    return out.select("key", "source", "size", "source_size", "target", _times().alias("times"))


def apply_mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", **kw) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, with all its columns.

    ``docs`` is read a second time for its texts. Places may differ between two reads, so the equal rows at a cut, if there are
    any, are staged with new ones.
    """
    sizes = sized(docs, key=key, source=source, text=text)
    bounds = cuts(sizes, targets(sizes, **kw))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"),
                       key_hash(key).alias("h"), row_hash(docs).alias("r"))
    rows = lookup_join(rows.withColumn("m", F.lit(None).cast("long")), bounds.drop("source_size", "target"), "source")
    copies = F.explode(F.array_repeat(F.lit(1), _times().cast("int")))
    if bounds.filter("same IS NOT NULL").isEmpty():
        return rows.withColumn("same_cut", F.lit(None).cast("long")).select("row", copies.alias("copy")).select("row.*")
    equal = F.coalesce((F.col("h") == F.col("tie")) & (F.col("r") == F.col("same")), F.lit(False))
    held = rows.filter(equal).select("row", "source", "h", "r", word_count(f"row.{text}").alias("size"),
                                     F.monotonically_increasing_id().alias("m"))
    held = staged(held, "mix-equal")
    held = lookup_join(held, singly(held, bounds).drop("source_size", "target"), "source")
    rest = rows.filter(~equal).withColumn("same_cut", F.lit(None).cast("long"))
    both = rest.select("row", copies.alias("copy")).unionByName(held.select("row", copies.alias("copy")))
    return both.select("row.*")
