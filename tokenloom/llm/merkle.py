"""Merkle manifest of a dataset through bitmap-rank indexing.

A leaf digests one record; the leaves of a group (source) ascend by id, every ``FAN`` consecutive nodes become one, and the
groups' roots are reduced in the same way to the root. Where a leaf stands is not found by sorting but by rank queries:

* ids are set bits of compressed bitmaps, one 64-bit word a row and no row for an empty word, merged by aggregation
  (``bit_or``, map-side first);
* a popcount directory counts the rows before each word: words are summed under nodes of ``2**NODE_BITS`` words, nodes under
  nodes, until a group has few enough for one window; offsets are then handed down, so no task orders a whole group;
* an id's rank is its word's offset plus the popcount of the lower bits. Words that hold a repeated id (more rows than bits)
  list the copies a bit.

Rows of one id get their places by the same index over the first 60 bits of their leaves, rows alike even there are numbered
in chunks as they were read. A place gives the key (run, slot) of a node, an aggregate by run puts the digests into slot
arrays, and each level is a written table 1 / ``FAN`` the size of the one below. Proofs go the other way, run by run.

Defined cases: a null value is digested as ``-``; null ids come first in their group and a null group first of all; rows of
one id stand in the order of their leaves (so repeated rows change nothing but the count); empty texts differ from null
ones; a null id isn't tampered with; an empty table gives an empty result. Other columns are not read. Hot groups cost nothing,
as every key but the group is even; a repeated id that holds a third of all rows meets one bitmap word in a join whose
partitions the session splits when they are skewed, and is dealt out again by leaf and chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import copy_numbers, read_chunk, staged
from tokenloom.operators.ordering import global_rank

FAN_BITS = 4
FAN = 1 << FAN_BITS
NODE_BITS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """UTF-8 byte count, colon and value; ``-`` for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def group_key(group: Column) -> Column:
    """A string that orders and compares like the group, null (first) included."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))


def tampered_ids(doc_id: str = "doc_id", every: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % every == 0, F.lit(False))


def leaves(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source",
           text: str = "text", tampered: Column | None = None) -> DataFrame:
    """(g, id, leaf, other, chunk) of every record, staged: texts are read once. ``other``: the leaf after tampering, which
    lower-cases the text's A-Z, where ``tampered`` holds."""
    def leaf(change: bool) -> Column:
        return digest(*[field(F.translate(F.col(c), UPPER, LOWER) if change and c == text else F.col(f"`{c}`")) for c in fields])

    other = F.when(tampered, leaf(True)) if tampered is not None else F.lit(None).cast("string")
    return staged(docs.select(group_key(F.col(group)).alias("g"), F.col(key).cast("long").alias("id"), leaf(False).alias("leaf"),
                              other.alias("other"), read_chunk().alias("chunk")), "merkle-leaves")


def _bit(value: str) -> Column:
    return F.col(value).bitwiseAND(F.lit(63)).cast("int")


def rank_index(rows: DataFrame, group: list[str], value: str) -> tuple[DataFrame, bool]:
    """(group, w, bits, n, more, before), staged, and whether any value repeats.

    A row is a bitmap word of ``value`` within ``group``: ``n`` rows fall in it, ``before`` rows of the group have a value in
    an earlier word (nulls, in a word of their own, come first), ``more`` lists (bit, further rows) of repeated values.
    """
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(value))
    words = staged(rows.groupBy(*group, F.shiftright(value, 6).alias("w")).agg(
        F.bit_or(one).alias("bits"), F.count(F.lit(1)).alias("n")), "merkle-words")
    crowded = words.filter(F.col("n") > F.coalesce(F.bit_count("bits"), F.lit(1)))
    repeats = not crowded.isEmpty()
    keys = [*group, "w"]
    more = F.lit(None).cast("array<struct<bit:int,k:long>>")
    if repeats:
        one_word = crowded.select(*[F.col(c).alias(f"__{c}") for c in keys])
        inside = rows.withColumn("w", F.shiftright(value, 6)).filter(F.col("w").isNotNull())
        inside = inside.join(one_word, _same(keys), "left_semi").groupBy(*keys, _bit(value).alias("bit")).agg(
            (F.count(F.lit(1)) - 1).alias("k")).filter("k > 0")
        extra = inside.groupBy(*keys).agg(F.collect_list(F.struct("bit", "k")).alias("more"))  # at most 64 bits
        extra = extra.select(*[F.col(c).alias(f"__{c}") for c in keys], "more")
        words = words.join(extra, _same(keys), "left").select(*keys, "bits", "n", "more")
    else:
        words = words.withColumn("more", more)
    # the popcount directory
    levels = [words.select(*group, F.col("w").alias("node"), "n")]
    while True:
        widest = levels[-1].groupBy(*group).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0]
        if not widest or widest <= 1 << NODE_BITS:
            break
        levels.append(staged(levels[-1].groupBy(*group, F.shiftright("node", NODE_BITS).alias("node")).agg(
            F.sum("n").alias("n")), "merkle-nodes"))
    earlier = Window.orderBy(F.col("node").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    top = levels.pop()
    offsets = top.select(*group, "node", F.coalesce(F.sum("n").over(earlier.partitionBy(*group)), F.lit(0)).alias("before"))
    while levels:
        below = levels.pop().withColumn("up", F.shiftright("node", NODE_BITS))
        inner = F.coalesce(F.sum("n").over(earlier.partitionBy(*group, "up")), F.lit(0))
        below = below.select(*group, "node", "up", inner.alias("inner"))
        above = offsets.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("node").alias("__up"), "before")
        offsets = below.join(above, _same([*group, "up"])).select(*group, "node", (F.col("before") + F.col("inner")).alias("before"))
    offsets = offsets.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("node").alias("__w"), "before")
    return staged(words.join(offsets, _same(keys)).select(*keys, "bits", "n", "more", "before"), "merkle-index"), repeats


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return on


def ranked(rows: DataFrame, index: DataFrame, group: list[str], value: str, rank: str, alike: str) -> DataFrame:
    """``rows`` with ``rank``, the rows of the group with a smaller value, and ``alike``, those with the same value."""
    words = index.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("w").alias("__w"),
                         *[F.col(c).alias(f"__{c}") for c in ("bits", "n", "more", "before")])
    bit = _bit(value)
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    def copies(some) -> Column:
        return F.coalesce(F.aggregate(F.filter("__more", some), F.lit(0).cast("long"), lambda s, x: s + x["k"]), F.lit(0))

    inner = F.bit_count(F.col("__bits").bitwiseAND(lower)) + copies(lambda x: x["bit"] < bit)
    out = rows.withColumn("w", F.shiftright(value, 6)).join(words, _same([*group, "w"]))
    return out.select(*rows.columns, (F.col("__before") + F.when(F.col(value).isNull(), 0).otherwise(inner)).alias(rank),
                      F.when(F.col(value).isNull(), F.col("__n")).otherwise(1 + copies(lambda x: x["bit"] == bit)).alias(alike))


def placed(rows: DataFrame) -> DataFrame:
    """(g, id, leaf, other, p) of :func:`leaves`: p numbers the leaves of a group from 0."""
    out = ["g", "id", "leaf", "other"]
    index, repeats = rank_index(rows, ["g"], "id")
    got = ranked(rows, index, ["g"], "id", "p", "n")
    if not repeats:
        return got.select(*out, "p")
    got = staged(got, "merkle-ranks")
    tied = got.filter("n > 1").withColumn("v", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"))
    index, repeats = rank_index(tied, ["g", "id"], "v")
    tied = ranked(tied, index, ["g", "id"], "v", "p2", "n2").withColumn("p", F.col("p") + F.col("p2"))
    parts = [got.filter("n = 1").select(*out, "p")]
    if repeats:
        tied = staged(tied, "merkle-ties")
        alike = copy_numbers(tied.filter("n2 > 1"), ["g", "id", "v"], "chunk", "copy")
        parts.append(alike.select(*out, (F.col("p") + F.col("copy")).alias("p")))
        tied = tied.filter("n2 = 1")
    parts.append(tied.select(*out, "p"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]) if len(parts) == 3 else parts[0].unionByName(parts[1])


def _runs(nodes: DataFrame, name: str, *extra: str) -> DataFrame:
    """(g, p, slots, digest), staged: ``FAN`` consecutive nodes (g, p, digest) each; a lone node stays what it is."""
    slot = F.struct(F.col("p").bitwiseAND(F.lit(FAN - 1)).cast("int").alias("slot"), "digest", *extra)
    runs = nodes.groupBy("g", F.shiftright("p", FAN_BITS).alias("up")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    lone = (F.col("up") == 0) & (F.size("slots") == 1)
    joined = F.array_join(F.transform("slots", lambda x: x["digest"]), "")
    return staged(runs.select("g", F.col("up").alias("p"), "slots",
                              F.when(lone, F.col("slots")[0]["digest"]).otherwise(digest(joined)).alias("digest")), name)


def reduced(runs: DataFrame) -> list[DataFrame]:
    """The levels above ``runs``, until every group has one node; ``runs`` is the first of the list."""
    levels = [runs]
    while not levels[-1].filter("p > 0").isEmpty():
        levels.append(_runs(levels[-1].select("g", "p", "digest"), "merkle-level"))
    return levels


_PATH = "array<struct<before:string,after:string>>"


def _siblings(slots: str, slot: Column) -> tuple[Column, Column]:
    def beside(some) -> Column:
        return F.array_join(F.transform(F.filter(slots, some), lambda x: x["digest"]), "")
    return beside(lambda x: x["slot"] < slot), beside(lambda x: x["slot"] > slot)


def _longer(slots: str, at: Column, lone: Column) -> Column:
    """The path of a node at slot ``at`` from that of its run: one more step, or none for a lone node."""
    before, after = _siblings(slots, at)
    step = F.array(F.struct(before.alias("before"), after.alias("after")))
    return F.when(lone, F.col("path")).otherwise(F.concat(step, F.col("path")))


def _lone(slots: str = "slots", p: str = "p") -> Column:
    return (F.col(p) == 0) & (F.size(slots) == 1)


def _down(level: DataFrame, paths: DataFrame, *keep: str) -> DataFrame:
    """(g, p, path, keep) of the nodes of ``level``'s runs, from those of the runs. A path's steps go upwards."""
    runs = level.select("g", "p", "slots").join(paths, ["g", "p"])
    each = runs.select("g", "p", "path", "slots", *keep, _lone().alias("lone"), F.explode("slots").alias("x"))
    return each.select("g", (F.shiftleft("p", FAN_BITS) + F.col("x.slot")).alias("p"),
                       _longer("slots", F.col("x.slot"), F.col("lone")).alias("path"), *keep)


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source",
             text: str = "text", tampered: Column | None = None) -> DataFrame:
    """(key, position, leaf, subroot, root, path, other) of every record.

    ``position`` is the leaf's place within its group, ``path`` the proof: per level the digests ``before`` and ``after`` the
    node in its run, up to the group's root and on to the root.
    """
    nodes = placed(leaves(docs, fields=fields, key=key, group=group, text=text, tampered=tampered))
    levels = reduced(_runs(nodes.withColumnRenamed("leaf", "digest"), "merkle-runs", "id", "other"))
    groups = levels[-1].select(F.col("g").alias("name"), "digest")
    groups = staged(global_rank(groups, "name", rank_col="p", total_col=None).select(
        F.lit("").alias("g"), (F.col("p") - 1).alias("p"), "digest", "name"), "merkle-groups")
    above = reduced(_runs(groups, "merkle-level"))
    paths = above[-1].select("g", "p", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    for level in reversed(above):
        paths = _down(level, paths, "root")
    paths = groups.select("p", "name", F.col("digest").alias("subroot")).join(paths.drop("g"), "p")
    paths = paths.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("p"), "path", "subroot", "root")
    for level in reversed(levels[1:]):
        paths = _down(level, paths, "subroot", "root")
    runs = levels[0].select("g", "p", "slots").join(paths, ["g", "p"])
    each = runs.select("p", "path", "slots", "subroot", "root", _lone().alias("lone"), F.explode("slots").alias("x"))
    return each.select(F.col("x.id").alias(key), (F.shiftleft("p", FAN_BITS) + F.col("x.slot")).alias("position"),
                       F.col("x.digest").alias("leaf"), "subroot", "root",
                       _longer("slots", F.col("x.slot"), F.col("lone")).alias("path"), F.col("x.other").alias("other"))


def proof_digest(path: str = "path") -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["before"], node, x["after"]))


def verify(made: DataFrame) -> DataFrame:
    """:func:`manifest` rows with ``proof_sha256``, ``folded_root`` (of the tampered leaf, if any) and ``verified``."""
    out = made.withColumns({"proof_sha256": proof_digest(), "folded_root": folded(F.coalesce("other", "leaf"))})
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
