import pytest
from pyspark.sql import functions as F

from tokenloom.operators.router import (
    domain_specialization,
    is_correct,
    pair_requests_predictions,
    tensor_violations,
)


def _records(spark):
    rows = [("d", [[[3.0, 1.0, 2.0], [0.0, 5.0, 5.0]], [[1.0, 1.0, 1.0], [9.0, 0.0, 1.0]]])]
    return spark.createDataFrame(rows, "domain string, router_logits array<array<array<double>>>")


def test_topk_counts_and_shares(spark):
    out = {(r.layer, r.expert): (r.n, r.share) for r in domain_specialization(_records(spark), k=2).collect()}
    assert [out[(0, e)][0] for e in range(3)] == [1, 1, 2]
    assert [out[(1, e)][0] for e in range(3)] == [2, 1, 1]
    assert [out[(0, e)][1] for e in range(3)] == [0.5, 0.5, 1.0]
    for layer in (0, 1):  # per-layer shares sum to k
        assert sum(out[(layer, e)][1] for e in range(3)) == pytest.approx(2.0)


def test_zero_fill_and_ragged(spark):
    rows = [("d", [[[1.0, 0.0, 0.0, 0.0]]]), ("d", [[[1.0, 2.0], [3.0]]]), ("d", [[[float("nan"), 1.0, 0.0, 0.0]]])]
    df = spark.createDataFrame(rows, "domain string, router_logits array<array<array<double>>>")
    out = domain_specialization(df, k=1).orderBy("expert").collect()
    assert [r.n for r in out] == [1, 0, 0, 0]  # ragged and NaN records excluded, experts zero-filled
    bad = {r.violation for r in tensor_violations(df.withColumn("i", F.lit(1)), id_cols=["i"]).collect()}
    assert bad == {"ragged", "nan_logit"}


def test_k_larger_than_experts_fails(spark):
    with pytest.raises(Exception, match="exceeds"):
        domain_specialization(_records(spark), k=4).collect()


def test_is_correct(spark):
    rows = [({"f1": 0.5, "em": 1.0},), ({"recall": 0.0},), ({},), ({"em": 1.0},), ({"f1": float("nan")},),
            ({"f1": None},), ({"f1": 0.0, "recall": 0.1},)]
    df = spark.createDataFrame(rows, "metrics map<string,double>")
    got = [r[0] for r in df.select(is_correct("metrics")).collect()]
    assert got == [True, False, False, False, False, False, True]


def test_pair_requests_predictions(spark):
    req = spark.createDataFrame([("x", "a", "ca"), ("x", "b", "cb"), ("x", "c", "cc")],
                                "domain string, native_id string, context string")
    pred = spark.createDataFrame(
        [("x", "a", [("A",)]), ("x", "b", [("B1",), ("B2",)]), ("x", "d", [("D",)])],
        "domain string, native_id string, model_output array<struct<continuation:string>>")
    out = {r.native_id: r for r in pair_requests_predictions(req, pred).collect()}
    assert out["a"].violation is None and out["a"].prompt == "caA" and out["a"]["index"] == 2
    assert out["b"].violation == "bad_output_count"
    assert out["c"].violation == "missing_prediction"
    assert out["d"].violation == "missing_request"


def _one(spark, *tensors, k=1, **kw):
    df = spark.createDataFrame([("d", t) for t in tensors], "domain string, router_logits array<array<array<double>>>")
    return domain_specialization(df, k=k, **kw).collect()


def test_null_logits_are_a_violation_and_rank_last(spark):
    from tokenloom.functions.tensors import topk_indices
    assert _one(spark, [[[1.0, None, 5.0, 3.0]]]) == []
    df = spark.createDataFrame([([1.0, None, 5.0, 3.0],)], "v array<double>")
    assert df.select(topk_indices("v", 4)).first()[0] == [2, 3, 0, 1]
    bad = spark.createDataFrame([(1, [[[1.0, None]]]), (2, [[None]]), (3, [None]), (4, None), (5, [[[1.0, 2.0]]])],
                                "i int, router_logits array<array<array<double>>>")
    assert {r.i: r.violation for r in tensor_violations(bad, id_cols=["i"]).collect()} == {
        1: "null_logit", 2: "null_logit", 3: "null_logit", 4: "empty"}


def test_mixed_shapes_fail(spark):
    with pytest.raises(Exception, match="different shape"):
        _one(spark, [[[1.0, 2.0, 3.0]]], [[[1.0] * 5], [[1.0] * 5]])


def test_domain_without_kept_tokens_is_absent(spark):
    assert _one(spark, [[[1.0, 2.0]]], token_index=1) == []
    got = _one(spark, [[[1.0, 2.0]]], [[[1.0, 2.0], [4.0, 3.0]]], token_index=1)
    assert [(r.expert, r.n, r.share) for r in sorted(got)] == [(0, 1, 1.0), (1, 0, 0.0)]
