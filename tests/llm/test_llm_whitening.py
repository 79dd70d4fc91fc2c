"""Whitening against exact fractions and numpy."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm.common import table
from tokenloom.llm.queries import QUERIES
from tokenloom.llm.whitening import charpoly, charpoly_mod, integers, isolate, null_vectors, whiten

SF = "/root/testdata/sf0.001"


def slow_charpoly(m):
    """Faddeev-LeVerrier in exact fractions."""
    d = len(m)
    eye = [[Fraction(i == j) for j in range(d)] for i in range(d)]
    mul = lambda a, b: [[sum(a[i][k] * b[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
    c, cur = [Fraction(1)], eye
    for k in range(1, d + 1):
        am = mul(m, cur)
        c.append(-sum(am[i][i] for i in range(d)) / k)
        cur = [[am[i][j] + c[-1] * eye[i][j] for j in range(d)] for i in range(d)]
    return [int(x) for x in c]


@pytest.mark.parametrize("rank", [7, 3, 0])
def test_polynomial(spark, rank):
    rnd = np.random.default_rng(rank)
    b = rnd.integers(-10 ** 6, 10 ** 6, (7, rank)).astype(object)
    m = [[int(x) for x in row] for row in (b @ b.T if rank else np.zeros((7, 7), object))]
    want = slow_charpoly(m)
    assert charpoly(spark, m) == want
    p = 2 ** 31 - 1
    assert charpoly_mod(np.array([[v % p for v in r] for r in m]), p).tolist() == [v % p for v in want]


def test_multiple_and_close_roots(spark):
    """An exactly double root, a pair 1e-25 apart, and a zero root."""
    big = 10 ** 30
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((6, 6)))
    m = np.diag(np.array([5 * big, 5 * big, 2 * big, 2 * big - 10 ** 5, big // 3, 0], object))
    # an integer rotation: Householder with an integer vector, scaled by its length
    u = np.array([1, 2, 3, 4, 5, 6], object)
    h = np.eye(6, dtype=int).astype(object) * int(u @ u) - 2 * np.outer(u, u)
    m = [[int(v) for v in r] for r in h @ m @ h.T]
    k2 = int(u @ u) ** 2
    poly, trace = charpoly(spark, m), sum(m[i][i] for i in range(6))
    roots = [isolate(poly, trace, k) for k in range(1, 7)]
    want = [5 * big, 5 * big, 2 * big, 2 * big - 10 ** 5, big // 3, 0]
    assert [(r.multiplicity, r.copy) for r in roots] == [(2, 0), (2, 1), (1, 0), (1, 0), (1, 0), (1, 0)]
    assert all(abs(Fraction(r.low, 1 << r.shift) - w * k2) <= Fraction(1, 1 << r.shift) for r, w in zip(roots, want))
    vs = np.array([null_vectors(m, r)[r.copy] for r in roots])
    np.testing.assert_allclose(vs @ vs.T, np.eye(6), atol=1e-14)
    exact = (h / int(u @ u)).astype(float)  # the columns are the eigenvectors
    np.testing.assert_allclose(np.abs((vs @ exact)[2:]), np.eye(6)[2:], atol=1e-14)
    np.testing.assert_allclose((vs[:2] @ exact)[:, 2:], 0, atol=1e-14)


def reckoned(rows):
    """{id: x} -> what the contract says, by numpy."""
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    e, v = np.linalg.eigh(z.T @ z / n)
    return n, s, e[::-1], v[:, ::-1]


def test_given_table(spark):
    rows = [(r.vec_id, r.x) for r in integers(table(spark, SF, "embeddings")).collect()]
    n, s, e, v = reckoned(rows)
    got = QUERIES["op12_whitening"](spark, SF).toPandas()
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    x = {i: x for i, x in rows}
    want_dev = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)) for i in x}
    assert (got.deviation == got.vec_id.map(want_dev)).all()
    for c, g in got.groupby("component"):
        np.testing.assert_allclose(g.explained, e[c - 1] / e.sum(), rtol=1e-9)
        want = np.array([(np.array(x[i]) - s / n) @ v[:, c - 1] for i in g.vec_id]) / np.sqrt(e[c - 1])
        w = g.whitened.to_numpy()
        np.testing.assert_allclose(w * np.sign(w @ want), want, rtol=1e-6, atol=1e-6)


def test_floor_and_copies(spark):
    """Floors of negative parts, copies and null ids count as rows, once in the fit; other columns may clash."""
    rows = [(1, [0.01, -0.01, 1.0]), (2, [0.5, 0.25, -1.0]), (2, [0.5, 0.25, -1.0]), (None, [3.0, 1e9, 2.0]),
            (4, None), (5, [None, 1.0, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 0.0, 0.0]), (8, []), (9, [1.0]),
            (10, [1e300, 0.0, 0.0]), (11, [0.015, -0.002, 1.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "'a' AS x")
    x = {r.vec_id: r.x for r in integers(df).collect()}
    assert x[1] == [1_000_000, 999_999, 1_000_064] and x[11] == x[1]
    got = whiten(df).toPandas()
    assert len(got) == 5 * 3 and set(got.n) == {3}  # 1 and 11 agree, 2 twice, the null id
    assert got[got.vec_id.isna()].shape[0] == 3
    # three points: two components, the third without variance
    third = got[got.component == 3]
    assert third.whitened.isna().all() and (third.explained == 0).all()
    # the huge deviations don't fit a long
    assert got[got.vec_id.isna()].deviation.isna().all()
    assert got.identity_error.max() < 1e-6


def test_one_vector_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25])] * 3, "vec_id long, embedding array<float>")
    got = whiten(df).toPandas()
    assert len(got) == 6 and set(got.n) == {1} and (got.deviation == 0).all()
    assert got.whitened.isna().all() and got.explained.isna().all() and (got.identity_error == 0).all()
    empty = whiten(df.limit(0))
    assert empty.count() == 0 and empty.columns == list(got.columns)


def test_partitions_do_not_matter(spark):
    df = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.sin(F.col("id") * k)).alias("v"))
    a = whiten(df, vec_id="id", vector="v").orderBy("vec_id", "component").toPandas()
    b = whiten(df.repartition(7), vec_id="id", vector="v").orderBy("vec_id", "component").toPandas()
    assert a.drop(columns="identity_error").equals(b.drop(columns="identity_error"))
