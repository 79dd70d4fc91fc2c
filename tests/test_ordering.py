import pytest
from pyspark.sql import functions as F

from tokenloom.operators.ordering import (
    batches, contiguous_chunks, global_rank, line_shards, named_splits, prefix_sum, range_buckets)


def test_named_splits(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = {r.k: r.split for r in named_splits(df, {"train": 6, "valid": 3}, "k").collect()}
    assert [out[i] for i in range(10)] == ["train"] * 6 + ["valid"] * 3 + [None]
    with pytest.raises(Exception, match="greater than dataset size"):
        named_splits(df, {"train": 11}, "k").collect()


def test_chunks_and_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    sizes = [r["count"] for r in contiguous_chunks(df, 4, "k").groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [3, 3, 3, 1]
    strided = {r.k: r.chunk for r in contiguous_chunks(df, 4, "k", strided=True).collect()}
    assert strided[5] == 1
    b = {r.k: r.batch_id for r in batches(df, 4, "k").collect()}
    assert b[3] == 0 and b[4] == 1 and b[9] == 2


def test_line_shards(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    counts = line_shards(df, 128, "k").groupBy("shard").count().collect()
    assert len(counts) == 150 and {r["count"] for r in counts} == {2}


def test_rank_is_partition_independent(spark):
    df = spark.range(5000).withColumn("k", (F.col("id") * 7919) % 100003)
    want = sorted(r.k for r in df.collect())
    for parts, buckets in ((1, 1), (13, 37), (4, 5)):
        x = global_rank(df.repartition(parts), "k", buckets=buckets)
        got = [r.k for r in x.orderBy("rank").collect()]
        assert got == want
        assert x.agg(F.max("rank")).first()[0] == 5000


@pytest.mark.parametrize("key,ties", [
    ("concat('doc_00000000', id)", False),  # strings with a common head
    ("id * 100000000000000 + id % 7", False),  # sparse 64-bit numbers
    ("id % 2000", True),  # many equally frequent keys
    ("CASE WHEN id % 3 > 0 THEN 7 ELSE id END", True),  # one hot key
    ("1", True)])  # one key, identical rows
def test_no_bucket_is_large_and_ranks_follow_the_key(spark, key, ties):
    df = spark.range(20_000).selectExpr(f"{key} AS k")
    sizes = [r["count"] for r in range_buckets(df, ["k"], ties, 20).groupBy("__bucket").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3000
    rows = global_rank(df, "k", ties=ties, buckets=20).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 20_001))
    assert [r.k for r in rows] == sorted(r.k for r in df.collect())


def test_null_keys_are_ranked_first(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3), (1, 4), (2, 5)], "k long, v long")
    got = global_rank(df, "k", ties=True).orderBy("rank").collect()
    assert [r.k for r in got] == [None, None, 1, 2, 3] and {r.n_total for r in got} == {5}
    part = prefix_sum(df, "v", "v", partition=["k"]).collect()
    assert sorted(r.start for r in part) == [0, 0, 0, 0, 1]
    assert global_rank(df.limit(0), "k").count() == 0


def test_asking_an_empty_table_fails(spark):
    with pytest.raises(Exception, match="greater than dataset size"):
        named_splits(spark.range(0).withColumnRenamed("id", "k"), {"train": 5}, "k").collect()


def test_duplicate_order_keys_are_rejected(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    with pytest.raises(Exception, match="not unique"):
        global_rank(df, "k").collect()


def test_chunks_and_splits_accept_repeating_keys(spark):
    df = spark.range(100).select((F.col("id") % 4).alias("k"))
    sizes = [r["count"] for r in contiguous_chunks(df, 4, "k", ties=True).groupBy("chunk").count()
             .orderBy("chunk").collect()]
    assert sizes == [26, 26, 26, 22]
    s = named_splits(df, {"a": 50, "b": 25}, "k", ties=True)
    got = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert got == {"a": 50, "b": 25, None: 25}
