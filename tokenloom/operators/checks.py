"""Plan-time schema checks and job-time invariant checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, cols: Iterable[str], what: str = "input") -> None:
    """Raise ``ValueError`` while building the plan if a required column is missing (no job runs)."""
    missing = [c for c in cols if c.split(".")[0] not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; has {df.columns}")


def allow_only(df: DataFrame, allowed: Iterable[str], what: str = "input") -> None:
    """Reject unknown columns at plan time."""
    extra = [c for c in df.columns if c not in set(allowed)]
    if extra:
        raise ValueError(f"Unknown column name(s) {extra} in {what}")


def assert_true(cond: Column, message: str) -> Column:
    """A boolean that is TRUE where ``cond`` holds and fails the job otherwise.

    Use inside ``where`` so the optimizer cannot prune it away.
    """
    return F.when(cond, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def optional_column(df: DataFrame, name: str, dtype: str) -> Column:
    """The column if present, else a typed NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)
