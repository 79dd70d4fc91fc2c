"""Router analytics: request/prediction pairing, correctness, expert counts, shares.

C1 pair_requests_predictions, C2 attach_metrics, B5 is_correct, B10 domain filter,
D1 expert_counts, D2 domain_specialization, D8 row_count_parity, H22/H23 via
``tokenloom.functions.tensors``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.tensors import slice_tokens, tensor_violation, topk_indices
from tokenloom.functions.text import col_
from tokenloom.operators.checks import assert_true, require_columns

# Metric names that mark a prediction as correct, in the order
# they are consulted (any one > 0 suffices).
CORRECT_METRICS = ("exact_match_simple", "exact_match", "f1", "recall", "exact_match_flex")


def is_correct(metrics, names: Sequence[str] = CORRECT_METRICS) -> Column:
    """Any named metric present, not NaN and > 0. NULL/NaN/missing count as not correct."""
    m = col_(metrics)
    checks = [F.coalesce(~F.isnan(m[n]) & (m[n] > 0), F.lit(False)) for n in names]
    out = checks[0]
    for c in checks[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def filter_domains(df: DataFrame, domains: Sequence[str] | None, domain: str = "domain") -> DataFrame:
    """Keep only configured domains (prunes directories when partitioned by domain)."""
    if domains is None:
        return df
    return df.where(F.col(domain).isin(list(domains)))


def pair_requests_predictions(requests: DataFrame, predictions: DataFrame, *,
                              keys: Sequence[str] = ("domain", "native_id"),
                              context: str = "context", outputs: str = "model_output") -> DataFrame:
    """Pair requests with predictions by key instead of by position.

    Output ``keys..., prompt, index, violation``; ``prompt``/``index`` are set only
    for valid pairs. ``violation`` is one of ``missing_prediction``,
    ``missing_request``, ``bad_output_count``, ``duplicate_id`` (NULL when valid).
    """
    keys = list(keys)
    require_columns(requests, keys + [context], "requests")
    require_columns(predictions, keys + [outputs], "predictions")
    req = (requests.groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("_nreq"), F.first(context).alias("_ctx")))
    pred = (predictions.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_npred"), F.first(outputs).alias("_out")))
    j = req.join(pred, keys, "full_outer")
    violation = (F.when(F.col("_nreq").isNull(), F.lit("missing_request"))
                 .when(F.col("_npred").isNull(), F.lit("missing_prediction"))
                 .when((F.col("_nreq") > 1) | (F.col("_npred") > 1), F.lit("duplicate_id"))
                 .when(F.coalesce(F.size("_out"), F.lit(-1)) != 1, F.lit("bad_output_count")))
    cont = F.get(F.col("_out"), 0)["continuation"]
    return (j.withColumn("violation", violation)
            .select(*keys,
                    F.when(F.col("violation").isNull(), F.concat(F.col("_ctx"), cont)).alias("prompt"),
                    F.when(F.col("violation").isNull(), F.length("_ctx")).alias("index"),
                    "violation"))


def row_count_parity(left: DataFrame, right: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """Per-group row counts of two tables and whether they agree."""
    by = list(by)
    lc = left.groupBy(*by).agg(F.count(F.lit(1)).alias("n_left"))
    rc = right.groupBy(*by).agg(F.count(F.lit(1)).alias("n_right"))
    return (lc.join(rc, by, "full_outer")
            .select(*by, F.coalesce("n_left", F.lit(0)).alias("n_left"),
                    F.coalesce("n_right", F.lit(0)).alias("n_right"))
            .withColumn("equal", F.col("n_left") == F.col("n_right")))


def attach_correct(router: DataFrame, predictions: DataFrame, *, keys: Sequence[str],
                   metrics: str = "metrics") -> DataFrame:
    """C2 + B5: keep router rows whose prediction (joined by key) is correct.

    A left-semi join: router rows are never widened, and AQE broadcasts the
    correct-key side only once it has measured it small enough.
    """
    keys = list(keys)
    good = predictions.where(is_correct(F.col(metrics))).select(*keys)
    return router.join(good, keys, "left_semi")


def expert_counts(df: DataFrame, *, k: int, domain: str = "domain", tensor: str = "router_logits",
                  token_index: str | int | None = None) -> DataFrame:
    """Per (domain, layer, expert) count of tokens that route to the expert in their top-k.

    Output ``domain, layer, expert, n, total_tokens``, zero-filled to every layer x expert of the domain;
    ``total_tokens`` = kept tokens of the domain. Records whose tensor is ragged, empty or holds NULL or NaN are excluded
    (see ``tensor_violations``), and so are those without kept tokens; a domain without any record left is absent.
    Records of different shape within a domain, or k above the number of experts, fail the job.

    One scan: each record gives its top-k hits and one row with its token count and shape; a partial
    aggregation by (domain, layer, expert), then one by domain, whose rows hold layers x experts counts.
    """
    require_columns(df, [domain, tensor], "router records")
    base = df.where(tensor_violation(F.col(tensor)).isNull())
    t = F.col(tensor)
    if token_index is not None:
        t = slice_tokens(t, F.col(token_index) if isinstance(token_index, str) else token_index)
    base = base.select(F.col(domain).alias("domain"), t.alias("_t")).where(F.size(F.get("_t", 0)) > 0)
    base = base.select("domain", "_t", F.size("_t").alias("_nl"), F.size(F.get("_t", 0)).cast("long").alias("_nt"),
                       F.size(F.get(F.get("_t", 0), 0)).alias("_ne"))
    none = F.lit(None).cast("int")
    # Top-k is taken inside the row so the explode is layers x tokens x k wide.
    hits = F.flatten(F.transform(F.col("_t"), lambda layer, li: F.flatten(F.transform(layer, lambda tok: F.transform(
        topk_indices(tok, k), lambda e: F.struct(li.alias("layer"), e.alias("expert"), F.lit(1).cast("long").alias("w"),
                                                 none.alias("nl"), none.alias("ne")))))))
    own = F.array(F.struct(F.lit(-1).alias("layer"), F.lit(-1).alias("expert"), F.col("_nt").alias("w"),
                           F.col("_nl").alias("nl"), F.col("_ne").alias("ne")))
    cells = base.select("domain", F.inline(F.concat(hits, own))).groupBy("domain", "layer", "expert").agg(
        F.sum("w").alias("n"), F.min("nl").alias("nl"), F.max("nl").alias("nl2"), F.min("ne").alias("ne"),
        F.max("ne").alias("ne2"))
    whole = F.col("layer") < 0
    per = cells.groupBy("domain").agg(
        F.max(F.when(whole, F.col("n"))).alias("total_tokens"), F.max("nl").alias("nl"), F.max("ne").alias("ne"),
        F.max((F.col("nl") != F.col("nl2")) | (F.col("ne") != F.col("ne2"))).alias("mixed"),
        F.map_from_entries(F.collect_list(F.when(~whole, F.struct(F.struct("layer", "expert"), "n")))).alias("m"))
    per = per.where(assert_true(~F.col("mixed"), "records of different shape in one domain"))
    per = per.where(assert_true(F.col("ne") >= k, f"k={k} exceeds the number of experts"))
    grid = per.select("domain", "total_tokens", "m", "ne", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("layer"))
    grid = grid.select("domain", "total_tokens", "m", "layer", F.explode(F.sequence(F.lit(0), F.col("ne") - 1)).alias("expert"))
    n = F.coalesce(F.try_element_at("m", F.struct("layer", "expert")), F.lit(0)).cast("long")
    return grid.select("domain", "layer", "expert", n.alias("n"), "total_tokens")


def domain_specialization(df: DataFrame, *, k: int, domain: str = "domain", tensor: str = "router_logits",
                          token_index: str | int | None = None) -> DataFrame:
    """Share of a domain's tokens that route each (layer, expert) into the top-k.

    Output ``domain, layer, expert, n, share``; per (domain, layer) the shares sum to k.
    """
    counts = expert_counts(df, k=k, domain=domain, tensor=tensor, token_index=token_index)
    return counts.select("domain", "layer", "expert", "n", (F.col("n") / F.col("total_tokens")).alias("share"))


def tensor_violations(df: DataFrame, *, id_cols: Sequence[str], tensor: str = "router_logits") -> DataFrame:
    """H23 report: records excluded from D1, with the reason."""
    return (df.select(*id_cols, tensor_violation(F.col(tensor)).alias("violation"))
            .where(F.col("violation").isNotNull()))
