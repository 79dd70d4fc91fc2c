"""Array expressions over router tensors ``[layers][tokens][experts]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.text import col_


def topk_indices(values, k: int) -> Column:
    """indices of the k largest values, ties to the lowest index.

    Computed inside the row (sort of (-value, index) structs), so no shuffle
    and no exploding of all experts is needed.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    tagged = F.transform(col_(values), lambda x, i: F.struct(x.isNull().alias("none"), (-x.cast("double")).alias("nv"),
                                                             i.alias("i")))  # NULLs come last
    return F.transform(F.slice(F.sort_array(tagged), 1, k), lambda s: s["i"])


def has_nan(values) -> Column:
    return F.exists(col_(values), lambda x: F.isnan(x))


def reshape(flat, dims: list[int]) -> Column:
    """Fold a flat array into nested arrays of the given (row-major) dims."""
    c = col_(flat)

    def build(level: int, base: Column) -> Column:
        if level == len(dims) - 1:
            return F.slice(c, base + 1, dims[-1])
        stride = 1
        for d in dims[level + 1:]:
            stride *= d
        return F.transform(F.sequence(F.lit(0), F.lit(dims[level] - 1)),
                           lambda j: build(level + 1, base + j * stride))

    return build(0, F.lit(0))


def slice_tokens(tensor, token_index) -> Column:
    """Keep positions ``token_index..`` of the token axis in every layer."""
    t = col_(token_index) if not isinstance(token_index, int) else F.lit(token_index)
    return F.transform(col_(tensor), lambda layer: F.slice(layer, t + 1, F.greatest(F.size(layer) - t, F.lit(0))))


def tensor_violation(tensor) -> Column:
    """NULL when ``[layers][tokens][experts]`` is rectangular and free of NULL and NaN, else a reason."""
    t = col_(tensor)
    n_tok = F.size(F.get(t, 0))
    n_exp = F.size(F.get(F.get(t, 0), 0))
    null = F.exists(t, lambda layer: layer.isNull() | F.exists(layer, lambda tok: tok.isNull() | F.exists(
        tok, lambda x: x.isNull())))
    ragged = F.exists(t, lambda layer: (F.size(layer) != n_tok)
                      | F.exists(layer, lambda tok: F.size(tok) != n_exp))
    nan = F.exists(t, lambda layer: F.exists(layer, lambda tok: has_nan(tok)))
    return (F.when(t.isNull() | (F.size(t) == 0), F.lit("empty"))
            .when(null, F.lit("null_logit"))
            .when(ragged, F.lit("ragged"))
            .when(nan, F.lit("nan_logit")))
