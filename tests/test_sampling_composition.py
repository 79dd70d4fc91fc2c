import gzip
import os

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.composition import (
    composition_rollup,
    directory_totals,
    path_columns,
    sidecar_token_counts,
    training_steps,
)
from tokenloom.operators.sampling import binary_balanced, concat_tables, nary_balanced


def test_binary_balanced(spark):
    df = spark.range(14).withColumn("flag", F.col("id") < 5)
    out = binary_balanced(df, F.col("flag"), n=4, seed=1, key=["id"])
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {True: 4, False: 4}
    with pytest.raises(Exception, match="fewer than 6"):
        binary_balanced(df, F.col("flag"), n=6, seed=1, key=["id"]).collect()
    with pytest.raises(Exception, match="fewer than 1"):  # a class without any row
        binary_balanced(df.where("flag"), F.col("flag"), n=1, seed=1, key=["id"]).collect()
    assert binary_balanced(df, F.col("flag"), n=6, seed=1, key=["id"], strict=False).count() == 11


@pytest.mark.parametrize("few", [0, 50, 4096])
def test_balanced_against_sorting(spark, monkeypatch, few):
    """Large n, keys that repeat (cut by a hash of the row) and rows alike in all columns (any of them, the right number)."""
    from collections import Counter

    from tokenloom.operators import sampling

    monkeypatch.setattr(sampling, "FEW", few)
    rows = [(i, i % 3 == 0, i // 50 if i % 2 else i) for i in range(3000)] + [(9000, True, 7)] * 900 + [(9000, False, 7)] * 10
    df = spark.createDataFrame(rows, "id long, flag boolean, k long").repartition(6)
    everything = binary_balanced(df, F.col("flag"), n=10 ** 6, seed=3, key=["k"], strict=False)
    assert everything.count() == len(rows)
    order = df.withColumn("tb", F.xxhash64("id", "flag", "k", "flag", F.md5(F.concat(F.lit("3:"), F.col("k").cast("string")))))
    order = [tuple(r) for r in order.select("flag", F.md5(F.concat(F.lit("3:"), F.col("k").cast("string"))).alias("o"),
                                            F.shiftrightunsigned("tb", 4), "id", "k").collect()]
    for n in (1, 40, 500, 1010):
        got = Counter((r.label, r.id, r.k) for r in binary_balanced(df, F.col("flag"), n=n, seed=3, key=["k"]).collect())
        want = Counter((x[0], x[3], x[4]) for f in (True, False) for x in sorted(x for x in order if x[0] == f)[:n])
        assert got == want, n


def test_nary_balanced_overlap(spark):
    df = spark.range(1, 7)
    out = nary_balanced(df, [F.col("id") % 2 == 0, F.col("id") > 3], n=2, seed=1, key=["id"])
    assert out.count() == 4


def test_concat_tables(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    assert sorted(tuple(r) for r in concat_tables([a, b]).collect()) == [(1, "x"), (2, "y")]


def test_sidecar_counts(spark, tmp_path):
    d1, d2 = tmp_path / "cat" / "sub1", tmp_path / "cat" / "sub2"
    os.makedirs(d1)
    os.makedirs(d2)
    with gzip.open(d1 / "a.csv.gz", "wt") as f:
        f.write("0,10\n10,25\n")
    with gzip.open(d2 / "b.csv.gz", "wt") as f:
        f.write("0,7\n")
    per_file = sidecar_token_counts(spark, str(tmp_path / "cat" / "*" / "*.gz"))
    totals = {r.directory.rsplit("/", 1)[-1]: r.total_tokens for r in directory_totals(per_file).collect()}
    assert totals == {"sub1": 25, "sub2": 7}
    assert sum(totals.values()) == 32


def test_training_steps_and_rollup(spark):
    c = spark.createDataFrame([("x", 1001)], "ds string, n_rows long")
    assert training_steps(c, batch_size=2, grad_accum=5, epochs=3).first().steps == 303
    df = spark.createDataFrame([("en", "a", 3), ("en", "b", 4), ("fr", "a", 5)], "lang string, src string, n_tokens int")
    r = {(x.category, x.subfolder): x.total_tokens for x in
         composition_rollup(df, category="lang", subfolder="src").collect()}
    assert r[("en", None)] == 7 and r[(None, None)] == 12 and r[("fr", "a")] == 5


def test_path_columns(spark):
    df = spark.createDataFrame([("/a/b/c.jsonl.gz",)], "p string")
    r = path_columns(df, "p").first()
    assert (r.parent, r.stem, r.clean) == ("/a/b", "c", "-a-b-c-jsonl-gz")


def test_first_n_concat_parts_filter_domains(spark):
    from tokenloom.operators.ordering import first_n
    from tokenloom.operators.router import filter_domains
    from tokenloom.operators.sampling import concat_parts

    df = spark.range(100).withColumn("key", (F.col("id") * 37) % 101)
    assert [r.key for r in first_n(df, 3, "key").collect()] == sorted(r.key for r in df.collect())[:3]
    parts = spark.createDataFrame([(1, 0, "c"), (0, 1, "b"), (0, 0, "a")], "chunk int, row int, v string")
    assert "".join(r.v for r in concat_parts(parts).collect()) == "abc"
    doms = spark.createDataFrame([("gsm8k",), ("mmlu",), ("arc",)], "domain string")
    assert sorted(r.domain for r in filter_domains(doms, ["gsm8k", "arc"]).collect()) == ["arc", "gsm8k"]
    assert filter_domains(doms, None).count() == 3
