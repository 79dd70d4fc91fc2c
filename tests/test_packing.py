from tokenloom.operators.packing import flat_token_stream, pack_sequences


def _docs(spark, shards=None):
    rows = [(0, [1, 2, 3], 1), (1, [4, 5], 1), (2, [6, 7, 8, 9], 2)]
    return spark.createDataFrame(rows, "k long, input_ids array<int>, shard int")


def test_pack_l4(spark):
    out = [r.input_ids for r in pack_sequences(_docs(spark), 4, "k", eos_id=0).orderBy("chunk").collect()]
    assert out == [[1, 2, 3, 0], [4, 5, 0, 6], [7, 8, 9, 0]]


def test_pack_l5_drops_tail(spark):
    out = [r.input_ids for r in pack_sequences(_docs(spark), 5, "k", eos_id=0).orderBy("chunk").collect()]
    assert out == [[1, 2, 3, 0, 4], [5, 0, 6, 7, 8]]


def test_pack_per_shard(spark):
    p = pack_sequences(_docs(spark), 4, "k", eos_id=0, shard_col="shard")
    out = sorted((r.shard, r.input_ids) for r in p.collect())
    assert out == [(1, [1, 2, 3, 0]), (2, [6, 7, 8, 9])]


def test_flat_stream(spark):
    p = pack_sequences(_docs(spark), 4, "k", eos_id=0)
    s = flat_token_stream(p, 4, max_id=65535).orderBy("pos").collect()
    assert [r.pos for r in s] == list(range(12)) and [r.token_id for r in s][:5] == [1, 2, 3, 0, 4]
    assert all(r.mask == 1 for r in s)


def test_pack_rejects_unknown_columns(spark):
    import pytest

    with pytest.raises(ValueError, match="Unknown column"):
        d = _docs(spark)
        pack_sequences(d.withColumn("extra", d["k"]), 4, "k", strict_columns=True)
