import numpy as np
import pytest
from pyspark.sql import functions as F

import tokenloom.llm.exact_topk as exact_module
from tokenloom.llm.exact_topk import exact_topk, floors
from tokenloom.llm.common import staged
from tokenloom.llm.hnsw import Graph, Regions, nearest
from tokenloom.llm.vectors import usable

SF = "/root/testdata/sf0.01"


def vectors(spark, n=900, dim=12, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[:copies] = x[0]
    rows = [(i, [float(v) for v in r], "x", 1.0, 2) for i, r in enumerate(x)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, dist double, rank int")


def top(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = []
    for q in queries:
        s = x @ x[ids == q][0]
        keep = np.flatnonzero(ids != q)
        o = keep[np.lexsort((ids[keep], -s[keep]))[:k]]
        out += [(q, i + 1, int(ids[j]), s[j]) for i, j in enumerate(o)]
    return out


@pytest.mark.parametrize("copies", [0, 400])
def test_exact_against_brute_force(spark, copies):
    rows, df = vectors(spark, n=6000, copies=copies)
    whole = [(i, np.floor(256 * np.array(v, np.float64)).tolist()) for i, v, *_ in rows]
    x = np.array([v for _, v in whole])
    v = floors(df)
    got = exact_topk(v, v.filter(F.col("vec_id") % 500 == 0), 5).collect()
    want = []
    for q in range(0, 6000, 500):
        s = (x @ x[q]).astype(np.int64)
        o = [j for j in np.lexsort((np.arange(6000), -s)) if j != q][:5]
        want += [(q, i + 1, int(j), int(s[j])) for i, j in enumerate(o)]
    assert sorted(map(tuple, got)) == want


def odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [0.0, 0.0]),
            (7, [1.0]), (None, [9.0, 9.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_exact_odd_rows(spark):
    v = floors(odd(spark))
    got = [tuple(r) for r in exact_topk(v, v.filter("vec_id = 0"), 5).collect()]
    assert sorted(got) == [(0, 1, 8, 327680), (0, 2, 9, 327680), (0, 3, 7, 65536), (0, 4, 6, 0)]
    assert exact_topk(v.limit(0), v.limit(0), 5).count() == 0


def test_exact_beyond_doubles(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 3.0])]
    v = floors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in exact_topk(v, v.filter("vec_id = 0"), 2).collect()]
    a = 768_000_000
    assert sorted(got) == [(0, 1, 2, a * a + 256 * 768), (0, 2, 1, a * a + 256 * 512)]


@pytest.mark.parametrize("copies", [0, 300])
def test_graph_search_recall(spark, copies):
    rows, df = vectors(spark, n=3000, dim=16, copies=copies)
    queries = [q for q in range(0, 3000, 60)]
    got = nearest(df, df.filter(F.col("vec_id").isin(queries)), 20, shard_rows=1000).collect()
    want = top(rows, queries, 20)
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, j) for q, _, j, _ in want}
    assert len(got) == len(want) and len(hit) >= 0.95 * len(want)
    score = {(q, j): s for q, _, j, s in top(rows, queries, 3000)}
    assert all(r.score == pytest.approx(score[r.query_id, r.vec_id], rel=1e-12) for r in got)


def test_graph_odd_rows(spark):
    df = odd(spark)
    got = sorted(tuple(r) for r in nearest(df, df.filter("vec_id = 0"), 5).collect())
    assert got == [(0, 1, 8, 5.0), (0, 2, 9, 5.0), (0, 3, 7, 1.0)]
    assert nearest(df.limit(0), df.limit(0), 5).count() == 0
    assert nearest(df.filter("vec_id = 7"), df.filter("vec_id = 7"), 5).count() == 0


def test_graph_reaches_all_and_packs():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 8)) + 40 * k for k in range(4)])  # far apart clusters
    g = Graph.unpack(Graph(np.arange(800), x, float((x ** 2).sum(axis=1).max())).pack())
    seen, todo = set(), [0]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [j for j in g.levels[0][n].tolist() if j >= 0]
    assert len(seen) == 800
    counts = [len(lv) for lv in g.levels]
    assert counts == sorted(counts, reverse=True) and counts[0] == 800


def test_given_vectors_recall(spark):
    """All queries of a given table over several regions, against brute force."""
    df = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    queries = [i for i, _ in rows if i % 20 == 0]
    got = nearest(df, df.filter(F.col("vec_id") % 20 == 0), 20, shard_rows=300).collect()
    want = top(rows, queries, 20)
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, j) for q, _, j, _ in want}
    assert len(got) == len(want) and len(hit) >= 0.9 * len(want)


def test_clustered_queries_visit_few_regions(spark):
    """A third of all rows in one cluster: several shards, and few regions a query."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 20
    cluster = np.where(rng.random(2400) < 1 / 3, 0, rng.integers(0, 12, 2400))
    x = (centres[cluster] + rng.normal(size=(2400, 8))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = staged(usable(df, "vec_id", "embedding"), "vectors")
    regions = Regions.fit(v, 200)
    assert len(regions.centres) == 12 and regions.visits(v, v.filter("vec_id % 20 = 0"), 10) <= 4
    got = nearest(df, df.filter("vec_id % 20 = 0"), 10, shard_rows=200).collect()
    want = top(rows, range(0, 2400, 20), 10)
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, j) for q, _, j, _ in want}
    assert len(got) == len(want) and len(hit) >= 0.95 * len(want)


def test_exact_beyond_longs(spark):
    rows = [(0, [3e16, 1.0]), (1, [3e16, 2.0]), (2, [-3e16, 3.0]), (3, [3.0, 1.0])]
    v = floors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in exact_topk(v, v.filter("vec_id = 0"), 3).collect()]
    most = (1 << 63) - 1  # saturated
    middle = 768 * 256 * 3 * 10 ** 16 + 256 * 256
    assert sorted(got) == [(0, 1, 1, most), (0, 2, 3, min(middle, most)), (0, 3, 2, -most)]


def test_exact_visits_few_blocks_of_clustered_vectors(spark, monkeypatch):
    """Vectors near 40 far centres: a query meets the blocks of its own cluster, and the answers stay exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 400
    centres /= np.linalg.norm(centres, axis=1)[:, None] / 4000
    x = np.floor(centres[np.arange(8000) % 40] + rng.normal(size=(8000, 8)) * 4)
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")
    monkeypatch.setattr(exact_module, "BLOCK", 64)
    met = []
    visit = exact_module.Index.visit
    monkeypatch.setattr(exact_module.Index, "visit", lambda self, pairs, k: (
        met.append((pairs.count(), self.blocks.count())), visit(self, pairs, k))[1])
    got = exact_topk(v, v.filter("vec_id % 100 = 0"), 5).collect()
    (home, blocks), (all_, _) = met
    assert home == 80 and blocks > 100
    assert all_ < 0.15 * 80 * blocks
    want = []
    for q in range(0, 8000, 100):
        s = (x @ x[q]).astype(np.int64)
        want += [(q, i + 1, int(j), int(s[j])) for i, j in
                 enumerate([j for j in np.lexsort((np.arange(8000), -s)) if j != q][:5])]
    assert sorted(map(tuple, got)) == want


def test_exact_queries_of_one_id_are_many_groups(spark, monkeypatch):
    """A third of the queries share an id but not a vector: they go to several sets."""
    rng = np.random.default_rng(5)
    x = rng.integers(-9, 9, (600, 4)).astype(float)
    rows = [(0 if i < 200 else i, r.tolist()) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    monkeypatch.setattr(exact_module, "QUERY_SET", 16)
    got = {(r.query_id, r.rank): r.score for r in exact_topk(v, v.filter("vec_id >= 590 OR vec_id = 0"), 3).collect()}
    for q in range(590, 600):
        s = np.sort((np.delete(x, q, 0) @ x[q]))[::-1]
        assert got[(q, 1)] == s[0]
