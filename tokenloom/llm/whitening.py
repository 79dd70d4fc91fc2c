"""Embedding whitening from an exact characteristic polynomial.

Vectors become integers x; over the fit list (each distinct x once) Spark sums the integer Gram matrix, from which follows the
integer scatter M = n * sum(x x') - S S' = n^2 * covariance, without any rounding. Its characteristic polynomial is found
modulo primes (Hessenberg reduction, one prime a row of a Spark job) and put together by Chinese remaindering. Because all
roots of that polynomial are real, the sign changes of its Taylor shift count the roots above a point exactly: the k-th root
is isolated by bisection on that count and refined by the polynomial's sign, in integers, to 2^-256 of the trace.
The component is the null space of M - root * I: inverse iteration in fixed-point integers, one component a row of a
Spark job. Every row is then projected.

What reaches the driver is d x d numbers and d + 1 coefficients for dimension d, whatever the number of rows. Defined cases:
vectors that are null, empty or hold null or non-finite entries, or entries of 2^40 or more in size, take no part, nor do
those whose dimension isn't the fit list's most common one (the larger of equals); null ids and repeated rows are rows
like any other (a repeated vector counts once in the fit); a root of multiplicity m (roots nearer than 2^-256 of the trace
count as one) gives m orthonormal components; where the eigenvalue is 0, ``whitened`` is null and ``explained`` 0 (null if the
trace is 0); a ``deviation`` beyond a long is null; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import staged
from tokenloom.llm.vectors import finite

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)
BITS = 256  # of the roots, and of the fixed-point vectors
GROUP = 4096  # rows of an exact product: 2^20 * 2^20 * 2^12 is below a double's 2^53
LIMB = 20
STEP = 32  # bits by which the places of a bisection get finer


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(finite("v"))
    rows = rows.filter(F.forall("v", lambda c: F.abs(c * SCALE) < LARGEST))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    """Rows of equal length as integers less SHIFT."""
    return np.asarray(x.flatten(), np.int64).reshape(-1, d) - SHIFT


def gram(fit: DataFrame, d: int) -> list[list[int]]:
    """Sums of products of all pairs of columns of (1, x - SHIFT), exact: n, sums and squares."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for b in batches:
            y = _matrix(b.column(0), d)
            for at in range(0, len(y), GROUP):
                part = np.concatenate([np.ones((len(y[at:at + GROUP]), 1), np.int64), y[at:at + GROUP]], axis=1)
                high = (part + (1 << LIMB - 1)) >> LIMB
                low = (part - (high << LIMB)).astype(float)
                total += (low.T @ low).astype(np.int64).astype(object)
                if high.any():
                    high = high.astype(float)
                    cross = (low.T @ high).astype(np.int64).astype(object)
                    total += (cross + cross.T << LIMB) + ((high.T @ high).astype(np.int64).astype(object) << 2 * LIMB)
        i, j = np.triu_indices(d + 1)
        if total[0, 0]:
            sums = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), sums], ["i", "j", "s"])

    sums = fit.select("x").mapInArrow(partial, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for r in sums.collect():
        out[r.i][r.j] = out[r.j][r.i] = int(r.s)
    return out


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits."""
    def is_prime(n: int) -> bool:
        s = (n - 1 & 1 - n).bit_length() - 1
        for a in (2, 3, 5, 7):  # enough below 3.2e9
            x = pow(a, n - 1 >> s, n)
            if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
                return False
        return True

    out, product, p = [], 1, (1 << 31) - 1
    while product >> bits == 0:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo ``p`` of det(xI - matrix), from x^d down: reduction to Hessenberg form, then its recurrence."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        pivot = np.flatnonzero(h[k + 1:, k])
        if not len(pivot):
            continue
        r = k + 1 + int(pivot[0])
        h[[k + 1, r]] = h[[r, k + 1]]
        h[:, [k + 1, r]] = h[:, [r, k + 1]]
        f = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * f % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # polys[k, i]: coefficient of x^i for the leading k x k block
    polys[0, 0] = 1
    for k in range(1, d + 1):
        c = np.zeros(k, np.int64)  # c[i]: h[i, k-1] times the subdiagonal entries between i and k - 1
        below = 1
        for i in range(k - 1, -1, -1):
            c[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (c[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d, ::-1]


def charpoly(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """Coefficients of det(xI - scatter), from x^d down, for a positive semidefinite integer matrix."""
    d, trace = len(scatter), sum(scatter[i][i] for i in range(len(scatter)))
    # the k-th coefficient is (-1)^k times the sum of products of k eigenvalues, at most comb(d, k) * (trace / d)^k
    bits = max((comb(d, k) * (trace // d + 1) ** k).bit_length() for k in range(d + 1)) + 1
    ps = primes(bits)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                m = np.array([[v % ps[i] for v in row] for row in scatter], np.int64)
                yield pd.DataFrame({"i": [i], "c": [charpoly_mod(m, ps[i]).tolist()]})

    jobs = spark.range(len(ps), numPartitions=min(len(ps), spark.sparkContext.defaultParallelism))
    residues = {r.i: r.c for r in jobs.mapInPandas(reduce, "i long, c array<long>").collect()}
    product, values = 1, [0] * (d + 1)  # Chinese remainders, a prime at a time
    for i, p in enumerate(ps):
        inverse = pow(product, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, residues[i], strict=True)]
        product *= p
    return [v - product if k % 2 and v else v for k, v in enumerate(values)]


@dataclass(frozen=True)
class Root:
    """The ``k``-th largest root: ``low / 2^shift`` or up to one unit more; ``copy`` numbers the components of a multiple one."""

    low: int
    shift: int
    multiplicity: int
    copy: int

    def value(self) -> float:
        return _ratio(self.low, 1 << self.shift)


def _ratio(a: int, b: int) -> float:
    """a / b (b positive) to double precision, whatever their size."""
    drop = max(0, min(a.bit_length(), b.bit_length()) - 1200)
    if abs(a.bit_length() - b.bit_length()) < 900 and not drop:
        return a / b
    e = a.bit_length() - b.bit_length() - 120
    scaled = a * (1 << -e) // b if e < 0 else a // (b << e)
    return float(scaled) * 2.0 ** e


def roots_above(poly: list[int], a: int, shift: int) -> int:
    """Number of roots of a real-rooted polynomial above ``a / 2^shift``: the sign changes of its Taylor shift (Descartes)."""
    c = [v << shift * k for k, v in enumerate(poly)]
    d = len(c) - 1
    for i in range(d):
        for j in range(1, d + 1 - i):
            c[j] += a * c[j - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign_at(poly: list[int], a: int, shift: int) -> int:
    v = 0
    for k, c in enumerate(poly):
        v = v * a + (c << shift * k)
    return (v > 0) - (v < 0)


def isolate(poly: list[int], trace: int, k: int) -> Root:
    """The ``k``-th largest root (from 1, with multiplicity) of the polynomial of a positive semidefinite matrix."""
    full, shift = (max(0, b - trace.bit_length()) for b in (BITS, STEP))
    low, high = -1, (trace << shift) + 1  # above low there are k roots or more, above high fewer
    above_low, above_high = len(poly) - 1, 0
    while True:
        while high - low > 1 and above_low - above_high > 1:
            mid = (low + high) // 2
            n = roots_above(poly, mid, shift)
            if n >= k:
                low, above_low = mid, n
            else:
                high, above_high = mid, n
        if shift == full:
            break
        finer = min(STEP, full - shift) if above_low - above_high > 1 else full - shift
        low, high, shift = low << finer, high << finer, shift + finer
    if high - low > 1:  # one root in (low, high]: the polynomial is of one sign below it
        below = 1 if above_low % 2 == 0 else -1
        while high - low > 1:
            mid = (low + high) // 2
            s = _sign_at(poly, mid, shift)
            low, high = (mid, high) if s == below else (low, mid)
    if _sign_at(poly, high, shift) == 0:
        low = high
    return Root(max(low, 0), shift, above_low - above_high, k - 1 - above_high)


def null_vectors(scatter: list[list[int]], root: Root) -> np.ndarray:
    """``multiplicity`` orthonormal vectors x with (scatter - root) x = 0, as doubles: inverse iteration in integers."""
    d = len(scatter)
    a = np.array(scatter, object) << root.shift if root.shift else np.array(scatter, object)
    a = a - np.diag(np.array([root.low] * d, object))
    rows = list(range(d))
    for k in range(d):
        r = max(range(k, d), key=lambda i: abs(a[i, k]))
        if r != k:
            a[[k, r]] = a[[r, k]]
            rows[k], rows[r] = rows[r], rows[k]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            f = (a[k + 1:, k] << BITS) // a[k, k]
            a[k + 1:, k + 1:] -= f[:, None] * a[k, k + 1:][None, :] >> BITS
            a[k + 1:, k] = f

    def normed(v: np.ndarray) -> np.ndarray:
        length = isqrt(int((v * v).sum()))
        return (v << BITS) // max(length, 1)

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[rows] << BITS
        for i in range(1, d):
            y[i] -= int((a[i, :i] * y[:i]).sum()) >> BITS
        for i in range(d - 1, -1, -1):
            y[i] = (y[i] - int((a[i, i + 1:] * y[i + 1:]).sum())) // a[i, i]
        return normed(y)

    rnd = np.random.default_rng(7)
    vs = [normed(np.array([int(v) for v in rnd.integers(1, 1 << 30, d)], object)) for _ in range(root.multiplicity)]
    for _ in range(3):
        done: list[np.ndarray] = []
        for v in map(solve, vs):
            for _ in range(2):
                for u in done:
                    v = v - (int((u * v).sum() >> BITS) * u >> BITS)
                v = normed(v)
            done.append(v)
        vs = done
    out = np.array([[float(c) * 2.0 ** -BITS for c in v] for v in vs])
    sign = np.sign(out[np.arange(len(out)), np.abs(out).argmax(axis=1)])
    return out * sign[:, None]


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` and sums of x - SHIFT, and per component its unit vector, eigenvalue and share of the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: tuple[float, ...]
    explained: tuple[float | None, ...]
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)


def components(spark: SparkSession, n: int, sums: list[int], scatter: list[list[int]], most: int) -> Whitening:
    d, trace = len(sums), sum(scatter[i][i] for i in range(len(sums)))
    poly = charpoly(spark, scatter)
    k = min(most, d)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                root = isolate(poly, trace, int(i) + 1)
                v = null_vectors(scatter, root)[root.copy]
                share = _ratio(root.low, trace << root.shift) if trace else None
                yield pd.DataFrame({"i": [i], "v": [v.tolist()], "e": [_ratio(root.low, n * n << root.shift)], "share": [share]})

    jobs = spark.range(k, numPartitions=k).mapInPandas(find, "i long, v array<double>, e double, share double")
    got = sorted(jobs.collect(), key=lambda r: r.i)
    return Whitening(n, tuple(sums), np.array([r.v for r in got]), tuple(r.e for r in got),
                     tuple(None if not trace else r.share for r in got))


def _projection(model: Whitening):
    """(deviation, whitened) of integer rows less SHIFT; a zero eigenvalue's column is NaN."""
    values = np.array(model.values)
    axes = np.where(values > 0, model.vectors.T / np.sqrt(np.where(values > 0, values, 1)), np.nan)
    largest_sum = max(map(abs, model.sums))

    def of(y: np.ndarray) -> tuple[list[int | None] | np.ndarray, np.ndarray]:
        largest = model.n * int(np.abs(y).max(initial=0)) + largest_sum  # exact in a long, or by Python's integers
        wide = largest * largest * model.dim >= 1 << 63
        z = y.astype(object) * model.n - np.array(model.sums, object) if wide else y * model.n - np.array(model.sums, np.int64)
        deviation = (z * z).sum(axis=1)
        if wide:
            deviation = [int(v) if v < 1 << 63 else None for v in deviation]
        return deviation, (z.astype(float) / model.n) @ axes
    return of


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, over components that have a variance."""
    of, d, live = _projection(model), model.dim, np.flatnonzero(np.array(model.values) > 0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live), len(live)))
        for b in batches:
            w = of(_matrix(b.column(0), d))[1][:, live]
            total += w.T @ w
        i, j = np.triu_indices(len(live))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    sums = fit.select("x").mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max((abs(r.s / model.n - (r.i == r.j)) for r in sums), default=0.0)


def fit(rows: DataFrame, most: int = 16) -> Whitening | None:
    """The whitening of :func:`integers` rows; None without rows."""
    spark = rows.sparkSession
    distinct = staged(rows.select("x").distinct(), "whitening-fit")
    dims = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if dims is None:
        return None
    d, distinct = dims.d, distinct.filter(F.size("x") == dims.d)
    g = gram(distinct, d)
    n, sums = g[0][0], g[0][1:]
    scatter = [[n * g[i + 1][j + 1] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    model = components(spark, n, sums, scatter, most)
    return Whitening(*[getattr(model, f) for f in ("n", "sums", "vectors", "values", "explained")], identity_error(distinct, model))


_COLUMNS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component."""
    rows = integers(vectors, vec_id, vector)
    model = fit(rows, most)
    id_type = dict(rows.dtypes)["vec_id"]
    if model is None:
        return rows.selectExpr("vec_id", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in _COLUMNS.split(", ")]).limit(0)
    of, d, k = _projection(model), model.dim, len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, GROUP):
                part = b.slice(at, GROUP)
                deviation, w = of(_matrix(part.column(1), d))
                m = part.num_rows
                pick = pa.array(np.repeat(np.arange(m), k))
                cols = [part.column(0).take(pick), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, model.n)), pa.array(deviation, pa.int64()).take(pick),
                        pa.array(w.ravel(), from_pandas=True), pa.array(list(model.explained) * m, pa.float64()),
                        pa.array(np.full(m * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained",
                                                       "identity_error"])

    return rows.filter(F.size("x") == d).mapInArrow(project, f"vec_id {id_type}, {_COLUMNS}")
