"""Approximate nearest neighbours through one small-world graph per shard.

Vectors belong to the region of their nearest centre (k-means of a bounded sample), and a region is cut by hash into
shards of about ``SHARD`` vectors, so a region that holds a third of all rows is many shards. Each shard becomes a hierarchical
navigable small-world graph over its distinct vectors, kept as flat arrays: nodes stand in order of falling level, so level l is
the first n_l nodes, and each level has one n_l x width array of neighbour places. The graph of a level links every node to
near ones chosen by the diversity rule (a candidate nearer to a chosen neighbour than to the node is passed over, then used to
fill up), adds the links back, and bridges parts the walk couldn't reach. As a shard is bounded, candidates come from blocked
matrix products. The index is a written table, one row a shard.

Queries travel to the graphs of their first few regions, and a graph meets at most ``ASKS`` queries at a time: a greedy
descent, then a beam of ``EF`` on the ground level, for all queries of a set at once; the shards' results are merged by exact
score. How many regions a query visits is measured, not set: the exact neighbours of ``PROBES`` queries among all vectors
tell how many hold the share ``ROUTED`` of them. Clustered vectors need few; where all distances are alike, most.

Nearness is the inner product; vectors are lifted by one component to equal length for the graph's distances.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part; rows equal in id and vector count
once; all rows with a query's id are its own; shorter vectors are padded with zeros; ties go to the smaller id; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tokenloom.llm.common import staged
from tokenloom.llm.exact_topk import best_of
from tokenloom.llm.vectors import lifted, matrix, usable

SHARD, QUERY_SET, ASKS = 4096, 512, 4096
#: At most this many regions (each of many shards on a large table), their centres fitted to so many vectors a region.
REGIONS, SAMPLE, ROUNDS = 512, 32, 10
PROBES, ROUTED = 128, 0.98
LINKS, CANDIDATES, EF, EXPAND = 16, 48, 96, 4
BLOCK = 256


class Graph:
    """The graph of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, largest: float):
        order = np.lexsort((ids, *x.T[::-1]))
        x, ids = x[order], ids[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(axis=1)
        start = np.append(np.flatnonzero(new), len(x))
        level = (-np.log(1 - np.random.default_rng(len(x)).random(len(start) - 1)) / math.log(LINKS)).astype(int)
        fall = np.argsort(-level, kind="stable")
        self.ids = [ids[start[i]:start[i + 1]] for i in fall]  # equal vectors are one node, its ids in order
        self.x = x[start[:-1]][fall]
        self.largest, self.at = largest, lifted(self.x, largest).astype(np.float32)
        counts = [int((level >= lv).sum()) for lv in range(level.max() + 1)]
        self.levels = [self._level(n, LINKS * (2 if lv == 0 else 1)) for lv, n in enumerate(counts)]
        self._bridge()

    def _level(self, n: int, width: int) -> np.ndarray:
        """Neighbour places of the first ``n`` nodes, -1 where there is none."""
        c = min(CANDIDATES, n - 1)
        if not c:
            return np.full((n, width), -1, np.int32)
        at, own = self.at[:n], min(LINKS, c)
        norm = np.einsum("ij,ij->i", at, at)
        near, far = np.empty((n, own), np.int64), np.empty((n, own), np.float32)
        for b in range(0, n, BLOCK):
            rows = np.arange(b, min(n, b + BLOCK))
            d = norm[rows, None] + norm - 2 * at[rows] @ at.T
            d[np.arange(len(rows)), rows] = np.inf
            cand = np.argpartition(d, c - 1, axis=1)[:, :c]
            dist = np.take_along_axis(d, cand, 1)
            o = np.argsort(dist, axis=1)
            cand, dist = np.take_along_axis(cand, o, 1), np.take_along_axis(dist, o, 1)
            v = at[cand]
            among = norm[cand][:, :, None] + norm[cand][:, None, :] - 2 * v @ v.transpose(0, 2, 1)
            chosen = np.zeros(cand.shape, bool)
            for j in range(c):  # the diversity rule, for the whole block at once
                hidden = (chosen[:, :j] & (among[:, j, :j] < dist[:, j, None])).any(axis=1)
                chosen[:, j] = ~hidden & (chosen.sum(axis=1) < own)
            o = np.argsort(~chosen, axis=1, kind="stable")[:, :own]  # passed-over ones fill up
            near[rows], far[rows] = np.take_along_axis(cand, o, 1), np.take_along_axis(dist, o, 1)
        u, v, d = np.repeat(np.arange(n), own), near.ravel(), far.ravel()
        u, v, d = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([d, d])
        back = np.repeat([0, 1], len(u) // 2)
        code, first = np.unique(u * n + v, return_index=True)  # a link both ways counts once, as its own
        u, v, d, back = u[first], v[first], d[first], back[first]
        o = np.lexsort((d, back, u))
        u, v = u[o], v[o]
        place = np.arange(len(u)) - np.searchsorted(u, u)
        out = np.full((n, width), -1, np.int32)
        fits = place < width
        out[u[fits], place[fits]] = v[fits]
        return out

    def _bridge(self) -> None:
        """Two-way links from every part of the ground level that node 0 doesn't reach to the nearest node it does."""
        g = self.levels[0]
        n = len(g)
        extra: dict[int, list[int]] = {}
        seen = np.zeros(n, bool)
        front = np.array([0])
        while True:
            while len(front):
                seen[front] = True
                nxt = g[front].ravel()
                more = [v for u in front.tolist() for v in extra.get(u, ())] if extra else []
                nxt = np.unique(np.concatenate([nxt[nxt >= 0], np.array(more, nxt.dtype)]))
                front = nxt[~seen[nxt]]
            left = np.flatnonzero(~seen)
            if not len(left):
                break
            reached = np.flatnonzero(seen)
            to = int(reached[np.argmin(((self.at[reached] - self.at[left[0]]) ** 2).sum(axis=1))])
            extra.setdefault(to, []).append(int(left[0]))
            extra.setdefault(int(left[0]), []).append(to)
            front = left[:1]
        if extra:
            more = np.full((n, max(map(len, extra.values()))), -1, np.int32)
            for u, vs in extra.items():
                more[u, :len(vs)] = vs
            self.levels[0] = np.concatenate([g, more], axis=1)

    def _distance(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances up to a constant a query; nowhere nodes are infinitely far."""
        v = self.at[nodes]
        d = np.einsum("qnd,qnd->qn", v, v) - 2 * np.einsum("qnd,qd->qn", v, q)
        return np.where(nodes < 0, np.inf, d)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, ef: int = EF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, vec_id, score) of the ``k`` nearest found for each query."""
        x = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        rows, n = np.arange(len(q)), len(self.x)
        cur = np.zeros(len(q), np.int64)
        here = self._distance(x, cur[:, None])[:, 0]
        for g in self.levels[:0:-1]:
            while True:
                d = self._distance(x, g[cur])
                j = d.argmin(axis=1)
                better = d[rows, j] < here
                if not better.any():
                    break
                cur = np.where(better, g[cur, j], cur)
                here = np.where(better, d[rows, j], here)
        ground = self.levels[0]
        ef = min(ef, n)
        beam, dist = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), np.inf, np.float32)
        open_ = np.zeros((len(q), ef), bool)
        beam[:, 0], dist[:, 0], open_[:, 0] = cur, here, True
        seen = np.zeros((len(q), n + 1), bool)  # the last column stands for nowhere
        seen[rows, cur] = True
        while (act := np.flatnonzero(open_.any(axis=1))).size:
            pick = np.argsort(~open_[act], axis=1, kind="stable")[:, :EXPAND]  # the nearest open ones
            valid = np.take_along_axis(open_[act], pick, 1)
            nodes = np.where(valid, beam[act[:, None], pick], -1)
            open_[act[:, None], pick] = False
            nxt = np.where((nodes >= 0)[:, :, None], ground[nodes], -1).reshape(len(act), -1)
            nxt = np.sort(nxt, axis=1)
            fresh = (nxt >= 0) & ~seen[act[:, None], nxt]
            fresh[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
            nxt = np.where(fresh, nxt, -1)
            seen[act[:, None], nxt] = True
            d = np.concatenate([dist[act], self._distance(x[act], nxt)], axis=1)
            o = np.argsort(d, axis=1, kind="stable")[:, :ef]
            beam[act] = np.take_along_axis(np.concatenate([beam[act], nxt], axis=1), o, 1)
            open_[act] = np.take_along_axis(np.concatenate([open_[act], fresh], axis=1), o, 1)
            dist[act] = np.take_along_axis(d, o, 1)
        return self._named(own, q, k, beam)

    def _named(self, own, q, k, beam):
        at, ids, scores = [], [], []
        for i in range(len(q)):
            nodes = beam[i][beam[i] >= 0]
            s = self.x[nodes] @ q[i]
            i_ids = [self.ids[j][:k + 1] for j in nodes]
            s = np.repeat(s, [len(a) for a in i_ids])
            a = np.concatenate(i_ids)
            s, a = s[a != own[i]], a[a != own[i]]
            o = np.lexsort((a, -s))[:k]
            at.append(np.full(len(o), i))
            ids.append(a[o])
            scores.append(s[o])
        return np.concatenate(at), np.concatenate(ids), np.concatenate(scores)

    def pack(self) -> bytes:
        lengths = np.array([len(i) for i in self.ids], np.int64)
        small = self.x.astype(np.float32)
        x = small if np.array_equal(small, self.x) else self.x  # what floats hold travels as floats
        return pickle.dumps((np.concatenate(self.ids), lengths, x, self.largest, self.levels), protocol=5)

    @classmethod
    def unpack(cls, data: bytes) -> Graph:
        g = cls.__new__(cls)
        ids, lengths, x, g.largest, g.levels = pickle.loads(data)
        g.x = x.astype(np.float64)
        g.at = lifted(g.x, g.largest).astype(np.float32)
        g.ids = np.split(ids, np.cumsum(lengths)[:-1])
        return g


@dataclass
class Regions:
    """Centres (lifted to equal length) of the regions; ``largest`` is the greatest squared length."""

    centres: np.ndarray
    dim: int
    largest: float

    @classmethod
    def fit(cls, vectors: DataFrame, shard_rows: int = SHARD) -> Regions:
        """k-means of the SAMPLE vectors a region that come first by hash."""
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        s = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("largest")).first()
        count, dim, largest = min(REGIONS, max(1, -(-s.n // shard_rows))), s.dim or 1, s.largest or 0.0
        if count == 1:
            return cls(np.zeros((1, dim + 1)), dim, largest)
        some = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE * count).select("v").toPandas()
        x = lifted(matrix(some["v"].tolist(), dim), largest)
        centres = np.unique(x, axis=0)
        centres = centres[np.random.default_rng(len(x)).permutation(len(centres))[:count]]
        for _ in range(ROUNDS):
            own = cls(centres, dim, largest).distances(x).argmin(axis=1)
            n = np.bincount(own, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        return cls(centres, dim, largest)

    def distances(self, at: np.ndarray) -> np.ndarray:
        """Squared distances of lifted vectors to the centres, up to a constant a row."""
        return (self.centres ** 2).sum(axis=1) - 2 * at @ self.centres.T

    def of(self, v: pd.Series) -> np.ndarray:
        return self.distances(lifted(matrix(v.tolist(), self.dim), self.largest)).argmin(axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Regions of each query, nearest first; a query's extra component is 0."""
        return self.distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1)).argsort(axis=1, kind="stable")

    def region(self, v: str = "v") -> Column:
        @F.pandas_udf("int")
        def udf(v: pd.Series) -> pd.Series:
            return pd.Series(self.of(v), dtype="int32")
        return udf(F.col(v))

    def first(self, v: str, visits: int) -> Column:
        @F.pandas_udf("array<int>")
        def udf(v: pd.Series) -> pd.Series:
            return pd.Series(list(self.order(matrix(v.tolist(), self.dim))[:, :visits].astype(np.int32)))
        return udf(F.col(v))

    def visits(self, vectors: DataFrame, asks: DataFrame, k: int) -> int:
        """How many of a query's regions hold the share ROUTED of its ``k`` nearest, by the first PROBES queries by hash."""
        if len(self.centres) == 1:
            return 1
        probes = asks.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PROBES).toPandas()
        if not len(probes):
            return 1
        own, q = probes["vec_id"].to_numpy(np.int64), matrix(probes["v"].tolist(), self.dim)
        place = self.order(q).argsort(axis=1)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The best of a task's vectors for each probe, as (query, vec_id, score, place of its region)."""
            best = None
            for p in batches:
                ids, x = p["vec_id"].to_numpy(np.int64), matrix(p["v"].tolist(), self.dim)
                score = np.where(ids == own[:, None], -np.inf, q @ x.T)
                where = place[:, self.of(p["v"])]
                here = [np.broadcast_to(ids, score.shape), score, where]
                best = here if best is None else [np.concatenate([b, h], axis=1) for b, h in zip(best, here)]
                o = np.argsort(-best[1], axis=1, kind="stable")[:, :k]
                best = [np.take_along_axis(b, o, 1) for b in best]
            if best is not None:
                ids, score, where = (b.ravel() for b in best)
                probe = np.repeat(np.arange(len(q)), best[0].shape[1])
                real = score > -np.inf
                yield pd.DataFrame({"probe": probe, "vec_id": ids, "score": score, "place": where})[real]

        found = vectors.mapInPandas(scan, "probe int, vec_id long, score double, place int")
        order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        held = np.zeros(len(self.centres))
        for r in found.groupBy("place").count().collect():  # at most one row a region
            held[r["place"]] = r["count"]
        share = held.cumsum() / max(held.sum(), 1)
        return int(np.argmax(share >= ROUTED)) + 1 if held.any() else 1


def build_index(vectors: DataFrame, regions: Regions, *, shard_rows: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The index of staged (vec_id, v) rows, one written row (region, shard, graph) a shard, and (region, shards)."""
    dim, largest = regions.dim, regions.largest

    def build(p: pd.DataFrame) -> pd.DataFrame:
        g = Graph(p["vec_id"].to_numpy(np.int64), matrix(p["v"].tolist(), dim), largest)
        return pd.DataFrame({"region": p["region"].iloc[:1], "shard": p["shard"].iloc[:1], "graph": [g.pack()]})

    rows = vectors.withColumn("region", regions.region())
    shards = F.greatest(F.round(F.count(F.lit(1)) / shard_rows), F.lit(1)).cast("int")  # under 1.5 * shard_rows vectors each
    shards = staged(rows.groupBy("region").agg(shards.alias("shards")), "regions")  # one row a region
    rows = rows.join(F.broadcast(shards), "region").withColumn(
        "shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int"))
    graphs = rows.groupBy("region", "shard").applyInPandas(build, "region int, shard int, graph binary")
    return staged(graphs, "hnsw"), shards


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding",
            shard_rows: int = SHARD, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query; ``queries`` are rows of ``vectors``."""
    narrow = "float" if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "double"

    def nonzero(rows: DataFrame) -> DataFrame:
        rows = usable(rows, vec_id, vector).filter(F.exists("v", lambda x: x != 0))
        return rows.withColumn("v", F.col("v").cast(f"array<{narrow}>"))  # floats travel as floats

    rows, asks = staged(nonzero(vectors), "vectors"), staged(nonzero(queries), "queries")
    regions = Regions.fit(rows, shard_rows)
    dim = regions.dim
    index, shards = build_index(rows, regions, shard_rows=shard_rows)
    routed = asks.withColumn("region", F.explode(regions.first("v", regions.visits(rows, asks, k))))
    parts = F.ceil(F.count(F.lit(1)) / ASKS).cast("int")
    plan = staged(routed.groupBy("region").agg(parts.alias("parts")).join(shards, "region"), "routes")  # one row a region
    routed = routed.join(F.broadcast(plan), "region").select(
        "region", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    graphs = index.join(F.broadcast(plan.select("region", "parts")), "region").select(
        "region", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "graph")

    def run(graph: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """About ASKS queries in one shard, a set at a time."""
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(graph) and len(asks):
            g = Graph.unpack(graph["graph"].iloc[0])
            own, q = asks["vec_id"].to_numpy(np.int64), matrix(asks["v"].tolist(), dim)
            for b in range(0, len(own), QUERY_SET):
                at, ids, score = g.search(own[b:b + QUERY_SET], q[b:b + QUERY_SET], k, ef)
                out.append(pd.DataFrame({"query_id": own[b:b + QUERY_SET][at], "vec_id": ids, "score": score}))
        return pd.concat(out[1:] or out)

    keys = ["region", "shard", "part"]
    found = graphs.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(
        run, "query_id long, vec_id long, score double")
    return best_of(found, k)
