import pytest
from pyspark.sql import functions as F

from tokenloom.llm.mixing import apply_mix, cuts, mix, sized, targets


def test_awkward_rows(awkward):
    got = mix(awkward).toPandas()
    assert len(got) == awkward.count()
    assert got[got.key.isin([100, 101, 102])]["size"].tolist() == [0, 0, 0]
    assert got[got.key == 103]["size"].tolist() == [90_000]
    assert got.times.between(0, 2).all()
    again = mix(awkward.repartition(7, "text")).toPandas()
    order = ["key", "source", "size", "times"]
    assert got.sort_values(order)[order].to_string(index=False) == again.sort_values(order)[order].to_string(index=False)


def test_targets_refill(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 50)], "source string, size long")
    t = {r.source: r.target for r in targets(sizes).collect()}
    # a is full at 20; null (4th, weight 5) is full at 100; b and c share the rest 2:1
    assert t["a"] == 20 and t[None] == 100
    assert t["b"] == pytest.approx((1.5 * 2060 - 120) * 2 / 3) and t["c"] == pytest.approx((1.5 * 2060 - 120) / 3)


def test_cut_against_sorting(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))
                                      .alias("source"), F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"))
    s = sized(docs)
    got = {r.source: r for r in cuts(s, targets(s)).collect()}
    for source, g in s.toPandas().groupby("source"):
        r = got[source]
        g = g.sort_values("h")
        mid = g["size"].cumsum() - g["size"] / 2
        want = g[mid <= r.target - r.passes * r.source_size]
        assert set(g[(g.h < r.cut) & (g["size"] > 0)].key) == set(want[want["size"] > 0].key)


def test_equal_keys_and_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 5, "doc_id long, text string, source string")
    # 15 words, target 22.5: two or three of the five come twice
    assert sorted(r.times for r in mix(docs).collect()) in ([1, 1, 1, 2, 2], [1, 1, 2, 2, 2])


def test_apply(awkward, nothing):
    times = {(r.key, r.source): r.times for r in mix(awkward).collect()}
    out = apply_mix(awkward)
    assert out.columns == awkward.columns
    from collections import Counter
    n, src = Counter((r.doc_id, r.source) for r in out.collect()), Counter((r.doc_id, r.source) for r in awkward.collect())
    assert all(n[k] == times[k] * c for k, c in src.items())
    assert mix(nothing).count() == 0 and apply_mix(nothing).count() == 0


def test_rows_that_share_a_key_are_cut_singly(spark):
    """Without ids, and on one id with rows that differ in another column only, the target is met to a document."""
    docs = spark.range(0, 3000, numPartitions=5).selectExpr(
        "CASE WHEN id % 2 = 1 THEN 7L END AS doc_id", "CASE WHEN id % 2 = 1 THEN 'a b c' ELSE 'word w' || id END AS text",
        "CASE WHEN id % 2 = 1 THEN 's' END AS source", "id AS n", "map('n', id) AS m")
    got = mix(docs).toPandas()
    got["taken"] = got["size"] * got["times"]
    assert got.groupby("source", dropna=False).taken.sum().sub(
        got.groupby("source", dropna=False).target.first()).abs().max() <= 3
    assert sorted(r.n for r in apply_mix(docs).collect()) == sorted(r.n for r in apply_mix(docs.repartition(3, "n")).collect())
    assert apply_mix(docs).count() == got.times.sum()


def test_a_third_of_equal_rows(spark):
    """Rows equal in all columns are cut singly: every source is within a document of its target, in both forms and however read."""
    rows = [(None, "a b c", s) for s in "xyz" for _ in range(1400)] + [(i, f"w{i} x", s) for i in range(200) for s in "xyz"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).toPandas()
    got["taken"] = got["size"] * got["times"]
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 1.5).all(), by
    from collections import Counter
    count = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    want = Counter()
    for r in got.itertuples():
        want[(None if r.key != r.key else int(r.key), "a b c" if r.key != r.key else f"w{int(r.key)} x", r.source)] += r.times
    assert count(apply_mix(docs)) == want == count(apply_mix(docs.repartition(7, "text", "doc_id")))
