import zlib

from tokenloom.llm.common import scratch_path
from tokenloom.llm.slots import SlotMap, load_map, save_map, shard


def test_bytes_law_and_places(spark, awkward, nothing):
    got = shard(awkward, 3).toPandas()
    assert len(got) == awkward.count() and shard(nothing, 3).count() == 0
    texts = {r.doc_id: r.text for r in awkward.collect()}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        t = (texts[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    for _, g in got.groupby("shard"):
        assert sorted(g.place) == list(range(len(g)))


def test_balance(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 AS int)) AS text")
    load = shard(docs, 8).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(load) == 8 and load.max() - load.min() <= 0.001 * load.mean() + 97


def test_growing_moves_only_into_the_new_shard():
    size = [(i * 7919) % 1000 for i in range(4096)]
    two = SlotMap.even(8).rebalanced(size)
    three = two.grown(size)
    assert (two.version, three.version, three.shards) == (2, 3, 9)
    assert all(b == 8 for a, b in zip(two.shard_of, three.shard_of) if a != b)
    load = three.loads(size)
    assert max(load) - min(load) <= 0.01 * sum(size) / 9


def test_versions_are_kept(spark):
    path, size = scratch_path(spark, "map"), [1] * 4096
    one = SlotMap.even(4)
    save_map(one.table(spark, size, size), path)
    save_map(one.rebalanced([i for i in range(4096)]).table(spark, size, size), path)
    assert load_map(spark, path).first().version == 2 and load_map(spark, path, 1).count() == 4096
    assert [r.shard for r in load_map(spark, path, 1).orderBy("vslot").collect()] == list(one.shard_of)


def test_common_and_missing_keys_and_equal_rows_spread(spark):
    docs = spark.range(0, 24_000, numPartitions=3).selectExpr(
        "CASE WHEN id % 3 = 2 THEN id WHEN id % 3 = 1 THEN 7 END AS doc_id",
        "CASE WHEN id % 3 = 1 THEN 'the same text again' ELSE repeat('y', cast(id % 50 AS int)) || id END AS text")
    got = shard(docs, 8).toPandas()
    load, rows = got.groupby("shard")["size"].sum(), got.groupby("vslot").size()
    assert len(load) == 8 and load.max() - load.min() <= 0.001 * load.mean() + 60 and rows.max() <= 40
    assert all(sorted(g.place) == list(range(len(g))) for _, g in got.groupby("shard"))
    cols = ["doc_id", "size", "text_crc32", "vslot", "shard", "place"]
    again = shard(docs.repartition(7, "text"), 8).toPandas()
    assert got[cols].sort_values(cols).to_string(index=False) == again[cols].sort_values(cols).to_string(index=False)
