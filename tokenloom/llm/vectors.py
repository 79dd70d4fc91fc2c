"""Vector helpers of the two search operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True for a non-empty vector without null, NaN or infinite components."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: finite vectors with an id; rows equal in both count once."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & finite("v")).distinct()


def matrix(rows, dim: int) -> np.ndarray:
    """Rows of numbers as a matrix; shorter ones end in zeros."""
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with one more component that brings each to the same length: then the larger an inner product with a
    query (whose own extra component is 0), the smaller the distance to it."""
    rest = np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1)
