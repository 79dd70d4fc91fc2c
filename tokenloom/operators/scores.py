"""Evaluation post-processing over saved logits.

H18 compare_logits, H19 argmax, H20 cross_entropy, H21 last_vector,
E7 next-token shift, D5 masked_loss (+ perplexity), D6 batch_perplexity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import col_


def compare_logits(logits, t0: int, t1: int) -> tuple[Column, Column, Column]:
    """``(logit[t0] > logit[t1], logit[t0], logit[t1])``."""
    lg = col_(logits)
    a, b = F.get(lg, t0).cast("double"), F.get(lg, t1).cast("double")
    return a > b, a, b


def argmax(logits) -> Column:
    """Index of the maximum (first one on ties); NULL for empty/NULL arrays."""
    lg = col_(logits)
    return (F.array_position(lg, F.array_max(lg)) - 1).cast("int")


def cross_entropy(logits, label) -> Column:
    """``logsumexp(logits) - logits[label]``, computed stably around the maximum."""
    at = col_(label).cast("int")

    def loss(lg: Column, mx: Column) -> Column:
        return mx + F.log(F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx))) - F.get(lg, at)

    # The cast array and its maximum are bound once: an expression inside the aggregate's lambda would run per element.
    doubles = F.transform(col_(logits), lambda x: x.cast("double"))
    return bind(doubles, lambda lg: bind(F.array_max(lg), lambda mx: loss(lg, mx)))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def next_token_losses(df: DataFrame, *, seq: str, pos: str, logits: str, label: str,
                      important: str | None = None) -> DataFrame:
    """Loss of position p = CE(logits[p], label[p+1]); ``important`` marks label positions.

    The important flag shifts with the label (index - 1); the first token has no
    loss, so an important first token is dropped. Positions are unique within a sequence. The window runs over the
    narrow label table only; the logits meet the next label in an equi-join on (seq, pos).
    """
    w = Window.partitionBy(seq).orderBy(pos)
    nxt = df.select(seq, pos, F.lead(label).over(w).alias("_next"),
                    *([F.lead(important).over(w).alias("_imp")] if important else []))
    x = df.join(nxt.where(F.col("_next").isNotNull()), [seq, pos])
    out = x.withColumn("ce", cross_entropy(logits, "_next"))
    if important:
        out = out.withColumn("important", F.coalesce(F.col("_imp"), F.lit(False)))
    return out.drop("_next", "_imp")


def masked_loss(losses: DataFrame, *, by: Sequence[str], important: str = "important",
                ce: str = "ce") -> DataFrame:
    """Mean CE over important positions per group, and ``exp`` of it; NULL when none is important."""
    return (losses.groupBy(*by)
            .agg(F.avg(F.when(F.col(important), F.col(ce))).alias("loss"))
            .withColumn("perplexity", F.exp("loss")))


def batch_perplexity(df: DataFrame, *, by: Sequence[str], loss: str = "loss") -> DataFrame:
    """``exp(mean(loss))`` per batch."""
    return df.groupBy(*by).agg(F.exp(F.avg(loss)).alias("perplexity"))


def last_vector(df: DataFrame, *, by: Sequence[str], pos: str, vector: str) -> DataFrame:
    """The vector at the last position of each sequence (``max_by``, a bounded aggregate)."""
    return df.groupBy(*by).agg(F.max(pos).alias("last_pos"), F.max_by(vector, pos).alias("last_vector"))
