"""Exact top-k by inner product over a pivot-distance index.

Vectors are lifted by one component to equal length, so that the largest inner product is the smallest distance. Each is
keyed by its nearest pivot and the distance to it; a range partitioning of (pivot, distance) gives sorted annuli,
packed into blocks of at most ``BLOCK`` vectors of one pivot. A query first searches the block of its nearest pivot whose
annulus is closest; its k-th score there bounds the search radius. Then only blocks whose annulus meets
[distance - radius, distance + radius] around their pivot are searched, and inside them only that stretch of the
sorted distances: all else is ruled out by the triangle inequality. Blocks meet queries in bounded groups of one block
and one set of queries; each gives its k best, which are merged.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part; rows equal in id and vector count
once; all rows with a query's id are its own; shorter vectors are padded with zeros; ties go to the smaller id; an
empty table gives an empty result. Components are integers and products exact; a product beyond 64 bits counts as the
largest (or smallest) long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import staged
from tokenloom.llm.vectors import finite, lifted, matrix, usable

PIVOTS, BLOCK, QUERY_SET = 64, 2048, 2048
MOST = (1 << 63) - 1
SLACK = 1e-6  # relative; far above rounding errors of the distances


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows: doubles while they are exact, else longs, saturated where they don't suffice."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
    if largest < 2 ** 52:
        return q @ x.T
    if largest < 2 ** 62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(x).T, -MOST, MOST).astype(np.int64)


def _best(score: np.ndarray, out: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest of each row, ties to the smaller of ``ids``; ``out`` marks those that don't count."""
    score[out] = -np.inf if score.dtype.kind == "f" else np.iinfo(np.int64).min
    keep = ~out
    if len(ids) > k:
        keep &= score >= np.partition(score, len(ids) - k, axis=1)[:, [len(ids) - k]]
    row, col = np.nonzero(keep)
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _keyed(rows: DataFrame, pivots: np.ndarray, largest: float, dim: int) -> DataFrame:
    """(vec_id, v, pivot, dist): nearest pivot of each vector and the distance to it."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = lifted(matrix(p["v"].tolist(), dim), largest)
                d = np.sqrt(np.maximum(2 * largest - 2 * x @ pivots.T, 0))
                near = d.argmin(axis=1)
                yield p.assign(v=list(x[:, :dim]), pivot=near, dist=d[np.arange(len(d)), near])
    return rows.mapInPandas(run, "vec_id long, v array<double>, pivot int, dist double")


def _packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (pivot, dist) to blocks of one pivot."""
    held: pd.DataFrame | None = None

    def block(b: pd.DataFrame) -> dict:
        return {"pivot": int(b["pivot"].iloc[0]), "lo": b["dist"].iloc[0], "hi": b["dist"].iloc[-1],
                "first": int(b["vec_id"].iloc[0]), "ids": b["vec_id"].tolist(), "dists": b["dist"].tolist(),
                "vecs": np.concatenate(b["v"].tolist())}

    def blocks(p: pd.DataFrame, last: bool) -> tuple[list[dict], pd.DataFrame | None]:
        out, rest = [], None
        for _, g in p.groupby("pivot", sort=True):
            for at in range(0, len(g), BLOCK):
                out.append(g.iloc[at:at + BLOCK])
        if not last and out and len(out[-1]) < BLOCK:
            rest = out.pop()
        return [block(b) for b in out], rest

    for p in parts:
        done, held = blocks(p if held is None else pd.concat([held, p]), last=False)
        if done:
            yield pd.DataFrame(done)
    if held is not None and len(held):
        yield pd.DataFrame(blocks(held, last=True)[0])


class Index:
    """Blocks (a staged table), pivots and bounds."""

    def __init__(self, vectors: DataFrame):
        """``vectors``: staged (vec_id, v) with integer components."""
        s = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"),
                        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("largest")).first()
        self.n, self.dim, self.largest = s.n, s.dim or 1, s.largest or 0.0
        some = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOTS).collect()  # PIVOTS rows
        self.pivots = lifted(matrix([r.v for r in some], self.dim), self.largest)
        parts = max(1, -(-self.n // BLOCK))
        keyed = _keyed(vectors, self.pivots, self.largest, self.dim) if self.n else None
        if keyed is None:
            return
        keyed = keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
        blocks = keyed.mapInPandas(_packed, "pivot int, lo double, hi double, first long, ids array<long>, "
                                            "dists array<double>, vecs array<double>")
        self.blocks = staged(blocks.withColumn("block", F.xxhash64("pivot", "lo", "hi", "first")), "annuli")

    def distances(self, queries: DataFrame) -> DataFrame:
        """(vec_id, v, ds): the distance of each query to each pivot."""
        pivots, largest, dim = self.pivots, self.largest, self.dim

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                q = np.concatenate([matrix(p["v"].tolist(), dim), np.zeros((len(p), 1))], axis=1)
                d = np.einsum("ij,ij->i", q, q)[:, None] + largest - 2 * q @ pivots.T
                yield p.assign(v=list(q[:, :dim]), ds=list(np.sqrt(np.maximum(d, 0))))
        return queries.mapInPandas(run, "vec_id long, v array<double>, ds array<double>")

    def visit(self, pairs: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): the ``k`` best of each block for each of its queries.

        ``pairs``: (block, vec_id, v, d, radius), an unknown radius null. A group is one block and one set of queries.
        """
        dim = self.dim

        def run(group: pa.Table) -> pa.Table:
            done = []
            for g in group.to_batches(max_chunksize=1):
                ids, dists, vecs = (g[c].flatten().to_numpy(zero_copy_only=False) for c in ("ids", "dists", "vecs"))
                asks = g["asks"].flatten()
                own, d, r = (asks.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "d", "radius"))
                q = asks.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                r = np.where(np.isnan(r), np.inf, r)
                lo, hi = np.searchsorted(dists, d - r), np.searchsorted(dists, d + r, side="right")
                at = np.arange(len(ids))
                out = (at < lo[:, None]) | (at >= hi[:, None]) | (ids == own[:, None])
                score = _products(q, vecs.reshape(-1, dim))
                row, col = _best(score, out, ids, k)
                done.append(pa.table([own[row], ids[col], score[row, col].astype(np.int64)], ["query_id", "vec_id", "score"]))
            return pa.concat_tables(done)

        sets = F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("asked") / QUERY_SET)).cast("int")
        asked = pairs.groupBy("block").agg(F.count(F.lit(1)).alias("asked"))
        asks = pairs.join(asked, "block").withColumn("part", sets).groupBy("block", "part").agg(
            F.collect_list(F.struct("vec_id", "v", "d", "radius")).alias("asks"))
        rows = asks.join(self.blocks.select("block", "ids", "dists", "vecs"), "block")
        return rows.groupBy("block", "part").applyInArrow(run, "query_id long, vec_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each query with the others.

    ``vectors`` and ``queries`` hold whole-number components; queries are rows of ``vectors``.
    """
    index = Index(staged(usable(vectors, vec_id, vector), "vectors"))
    if not index.n:
        return queries.select(F.col(vec_id).cast("long").alias("query_id"), F.lit(1).alias("rank"),
                              F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    asks = staged(index.distances(usable(queries, vec_id, vector)), "queries")
    summary = index.blocks.select("block", "pivot", "lo", "hi")
    least = F.array_min("ds")
    nearest = asks.select("vec_id", "v", least.alias("d"), (F.array_position("ds", least) - 1).cast("int").alias("pivot"))
    gap = F.greatest(F.col("lo") - F.col("d"), F.col("d") - F.col("hi"), F.lit(0.0))
    home = nearest.join(summary, "pivot").groupBy("vec_id", "v", "d").agg(F.min(F.struct(gap, "block")).alias("h"))
    home = home.select(F.col("h.block").alias("block"), "vec_id", "v", "d", F.lit(None).cast("double").alias("radius"))
    first = index.visit(home, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = best_of(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) + F.lit(index.largest)
    radius = F.sqrt(F.greatest(squared - 2 * F.col("score"), F.lit(0.0)) + F.lit(SLACK) * (squared + 1))
    radius = F.when(F.col("score").isNotNull(), radius).otherwise(float("inf"))  # fewer than k at home: everywhere
    bound = staged(asks.join(kth, "vec_id", "left").groupBy("vec_id").agg(F.max(radius).alias("radius")), "radii")
    near = asks.select("vec_id", "v", F.posexplode("ds").alias("pivot", "d")).join(bound, "vec_id")
    pairs = near.join(summary, "pivot").filter(
        (F.col("lo") <= F.col("d") + F.col("radius")) & (F.col("hi") >= F.col("d") - F.col("radius")))
    found = index.visit(pairs.select("block", "vec_id", "v", "d", "radius"), k)
    return best_of(found, k)


def floors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components floor(``scale`` * x), of finite vectors."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(finite("v"))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
