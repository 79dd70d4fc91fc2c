"""SimHash near-duplicates through BK-trees.

Fingerprints are computed a row at a time in Arrow batches. Equal fingerprints collapse to one; the distinct ones
are dealt to shards by the bits of two of ``max_distance + 2`` blocks (at most ``max_distance`` differing bits leave two
blocks equal, so every link lies in some shard). A shard of at most ``TREE`` fingerprints becomes a BK-tree, whose nodes'
children are keyed by Hamming distance to the parent, and is searched by its fingerprints following only edges
within the radius. A larger shard is dealt again, by two blocks of those bits that differ in it: w of them hold at most
2^w fingerprints and about 3/5 of them still differ afterwards, so few rounds end it, each with 10 copies of a fingerprint (at
3 bits) however many there are; equal shards of different blocks merge. A task gets bounded trees and emits a
spanning forest of the links it found, never all pairs; the forests meet in a distributed connected-components run.
Trees stay where the shuffle of their shard built them and are not broadcast by the driver: together they hold the
fingerprints of all documents, which no driver may gather.

Defined cases: null and empty texts have fingerprint 0 and link like any other; fewer words than a shingle make one
shingle of all; ``component_id`` is the smallest non-null id reachable (null if all ids are null); components
that share an id, or have none, stay apart in ``keep_one``; repeated rows are one group; an empty table gives an empty result. Other columns are not read (``keep_one`` passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import staged

BITS = 64
TREE = 4096
CHUNK = 1 << 14  # shingles hashed at a time
FRONTIER = 1 << 20  # tree nodes that a batch of queries may visit together


def simhash(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    n, ones = len(w) - words + 1, np.zeros(BITS, np.int64)
    shingles = map(b" ".join, zip(*(islice(w, i, None) for i in range(words))))
    digest = xxhash.xxh64_intdigest
    while part := [digest(s, 42) for s in islice(shingles, CHUNK)]:
        h = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    @F.pandas_udf("long")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in s], dtype="int64")
    return udf(text)


# ---- BK-trees over flat arrays; many small trees (groups) are built and searched together ----

class Forest:
    """BK-trees of several groups: ``node`` holds item numbers, children of a node are found by (node, distance)."""

    def __init__(self, prints: np.ndarray, items: np.ndarray, group: np.ndarray):
        """``items``: places in ``prints``, sorted by ``group`` (of equal length); the first of a group is its root."""
        first = np.ones(len(items), bool)
        first[1:] = group[1:] != group[:-1]
        self.prints, self.root = prints, dict(zip(group[first].tolist(), items[first].tolist()))
        below = items[first][np.cumsum(first) - 1]  # the node each open item stands at
        rest, at = items[~first], below[~first]
        codes, nodes = [], []
        while len(rest):
            code = at * (BITS + 1) + np.bitwise_count(prints[rest] ^ prints[at]).astype(np.int64)
            slot, where, back = np.unique(code, return_index=True, return_inverse=True)
            codes.append(slot)
            nodes.append(rest[where])  # the first item of a slot becomes its node, the others descend to it
            stay = np.ones(len(rest), bool)
            stay[where] = False
            at, rest = rest[where][back][stay], rest[stay]
        self.codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        order = np.argsort(self.codes)
        self.codes, self.nodes = self.codes[order], self.nodes[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query item, tree item) of all pairs within ``radius``, an item's own node left out."""
        q, node, found = queries, roots, []
        while len(q):
            d = np.bitwise_count(self.prints[q] ^ self.prints[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            if hit.any():
                found.append((q[hit], node[hit]))
            base = node * (BITS + 1)
            lo = np.searchsorted(self.codes, base + np.maximum(d - radius, 0))
            n = np.searchsorted(self.codes, base + np.minimum(d + radius, BITS), side="right") - lo
            q = np.repeat(q, n)
            node = self.nodes[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(q))]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def merge_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (smallest item of the component so far) after adding links u-v."""
    while True:
        a, b = label[u], label[v]
        far = a != b
        if not far.any():
            return label
        u, v = u[far], v[far]
        np.minimum.at(label, a[far], b[far])
        np.minimum.at(label, b[far], a[far])
        while (label[label] != label).any():
            label = label[label]


def link_groups(prints: np.ndarray, group: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the items: two items of a group share one if a chain of links found by the group's queries joins them."""
    label = np.arange(len(prints))
    tree = np.flatnonzero(in_tree)
    forest = Forest(prints, tree, group[tree])
    ids, counts = np.unique(group[tree], return_counts=True)
    queries = np.flatnonzero(asks)
    queries = queries[np.isin(group[queries], ids)]
    at = np.searchsorted(ids, group[queries])
    roots = np.array([forest.root[g] for g in ids.tolist()], np.int64)
    part = np.cumsum(counts[at]) // FRONTIER if len(queries) else at
    for _, lo, n in zip(*np.unique(part, return_index=True, return_counts=True)):
        u, v = forest.search(queries[lo:lo + n], roots[at[lo:lo + n]], radius)
        label = merge_labels(label, u, v)
    return label


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by k: the prints of a k are one tree, searched by all of them."""
        held: list[dict[str, np.ndarray]] = []

        def edges(x: dict[str, np.ndarray]) -> pa.RecordBatch:
            group = np.cumsum(np.append(True, x["k"][1:] != x["k"][:-1]))
            every = np.ones(len(group), bool)
            label = link_groups(x["fp"].view(np.uint64), group, every, every, radius)
            far = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(x["fp"][far]), pa.array(x["fp"][label[far]])], names=["u", "v"])

        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "fp")}
            if not len(x["k"]):
                continue
            start = int(np.argmax(x["k"] == x["k"][-1]))  # the last group may go on in the next batch
            if start or held and held[-1]["k"][-1] != x["k"][0]:
                done = [*held, {c: v[:start] for c, v in x.items()}]
                yield edges({c: np.concatenate([h[c] for h in done]) for c in x})
                held = []
            held.append({c: v[start:] for c, v in x.items()})
        if held:
            yield edges({c: np.concatenate([h[c] for h in held]) for c in held[0]})
    return run


def block_masks(max_distance: int, within: int = (1 << BITS) - 1) -> list[int]:
    """Masks, as signed longs, of every two of ``max_distance + 2`` blocks of the bits ``within``, and all other bits."""
    bits = [1 << i for i in range(BITS) if within >> i & 1]
    ends = [len(bits) * i // (max_distance + 2) for i in range(max_distance + 3)]
    blocks = [sum(bits[lo:hi]) for lo, hi in zip(ends, ends[1:])]
    rest = (1 << BITS) - 1 - (within & (1 << BITS) - 1)
    masks = [rest | a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]


def links(prints: DataFrame, max_distance: int = 3, tree_rows: int = TREE) -> DataFrame:
    """(u, v): links that join, directly or in chains, all distinct fingerprints ``fp`` within ``max_distance`` bits.

    Groups of at most ``tree_rows`` prints are linked; the others are split by the bits that differ in them until none is left.
    """
    if tree_rows < 1 << max_distance + 1:
        raise ValueError(f"tree_rows must be {1 << max_distance + 1} or more")  # else a group might not get smaller

    def split(masks: Column) -> Column:
        return F.explode(F.transform(masks, lambda m: F.xxhash64(m, F.col("fp").bitwiseAND(m))))

    @F.pandas_udf("array<long>")
    def finer(differ: pd.Series) -> pd.Series:
        return pd.Series([block_masks(max_distance, d) for d in differ])

    rows = prints.select("fp", split(F.lit(block_masks(max_distance))).alias("k"))
    found = None
    while True:
        groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all"))
        groups = staged(groups.filter("n > 1"), "groups")
        whole = rows.join(groups.filter(F.col("n") <= tree_rows).select("k"), "k")
        whole = whole.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(_linker(max_distance), "u long, v long")
        found = whole if found is None else found.unionByName(whole)
        heavy = groups.filter(F.col("n") > tree_rows)
        if heavy.isEmpty():
            return found
        heavy = heavy.select("k", finer(F.col("any").bitwiseXOR(F.col("all"))).alias("masks"))
        rows = staged(rows.join(heavy, "k").select("fp", split(F.col("masks")).alias("k")).distinct(), "split")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (u, v); nodes without edges are left out.

    Alternating large-star and small-star rounds, each two aggregations and joins on the node and a written
    table; rounds needed grow with the logarithm of the longest chain. Only a checksum of the edges reaches the driver.
    """
    def sums(e: DataFrame):
        h = F.xxhash64("u", "v")
        return e.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 8)), F.sum(h.bitwiseAND(F.lit(255)))).first()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e if not large else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u")
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else (
            out.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))))
        return out.filter("u != v").distinct()

    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(),
               "links")
    before = sums(e)
    while True:
        e = staged(star(star(e, large=True), large=False), "stars")
        now = sums(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(prints: DataFrame, *, max_distance: int = 3, hot_share: int = 1000) -> DataFrame:
    """``prints`` (a staged table with doc_id and fp) with ``component_id`` and ``root``, a fingerprint that tells
    components apart (ids may be null or repeat).

    The class of a fingerprint is looked up per row. At most ``hot_share`` fingerprints can each hold over
    1/``hot_share`` of the rows; those are broadcast, so no task gathers a fingerprint's rows.
    """
    total = prints.count()
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "prints")
    roots = connected_components(links(distinct.select("fp"), max_distance))
    member = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "n", "rep", F.coalesce("root", "fp").alias("root"))
    member = staged(member, "members")
    best = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    class_of = staged(member.join(best, "root").select("fp", "n", "root", "component_id"), "classes")
    hot = class_of.filter(F.col("n") * hot_share >= total).select("fp", "root", "component_id")
    cold = class_of.filter(F.col("n") * hot_share < total).select("fp", "root", "component_id")
    return prints.join(F.broadcast(hot), "fp").unionByName(
        prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp"))


def simhash_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3,
                   max_distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = staged(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp")), "simhash")
    return components(prints, max_distance=max_distance).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3,
             max_distance: int = 3) -> DataFrame:
    """One row of each group, all its columns: the smallest (id, text hash) of the group, once if repeated."""
    th = F.xxhash64(F.col(text))
    prints = staged(docs.select(F.col(doc_id).alias("doc_id"), th.alias("th"), fingerprint(F.col(text), words).alias("fp")),
                    "simhash")
    groups = components(prints, max_distance=max_distance)
    keep = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("k"))
    keep = keep.select(F.col("k.doc_id").alias("kd"), F.col("k.th").alias("kt"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(doc_id).alias("d"), th.alias("t"))
    rows = rows.join(keep, F.col("d").eqNullSafe(F.col("kd")) & (F.col("t") == F.col("kt")), "left_semi")
    once = F.row_number().over(Window.partitionBy("d", "t").orderBy("d"))
    return rows.withColumn("o", once).filter("o = 1").select("row.*")
