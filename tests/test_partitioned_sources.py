"""A1 zstd lines, A3 callable sources and A11 token files."""

import os
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tokenloom.operators.packing import pack_sequences
from tokenloom.sources.partitioned import from_generator, read_zstd_lines, zstd_frames
from tokenloom.sources.readers import read_any, read_lines
from tokenloom.sources.token_files import read_token_files, write_token_files


def lines_of(df):
    return sorted(r.line for r in df.collect())


def compress(data: bytes, cuts, **kw) -> bytes:
    at = [0, *sorted(cuts), len(data)]
    frames = [zstandard.ZstdCompressor(**kw).compress(data[a:b]) for a, b in zip(at, at[1:])]
    return (b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc").join(frames)  # skippable frames in between


def test_frames_of_all_kinds(tmp_path):
    import pyarrow as pa
    rnd = random.Random(1)
    for data in (b"", b"x", b"a" * 300_000, rnd.randbytes(400_000)):
        for kw in ({}, {"write_checksum": True}, {"write_content_size": False}, {"level": 19}):
            packed = compress(data, [len(data) // 3], **kw)
            got = list(zstd_frames(pa.BufferReader(packed)))
            assert b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(packed[a:b]) for a, b in got) == data
            assert len(got) == 2
    with pytest.raises(ValueError):
        list(zstd_frames(pa.BufferReader(packed[:-100])))
    with pytest.raises(ValueError):
        list(zstd_frames(pa.BufferReader(b"plain text")))


def test_zstd_lines_over_frames(spark, tmp_path):
    """Lines that span frames, end right at them, are empty, end in a carriage return or hold broken bytes."""
    rnd = random.Random(3)
    for k in range(4):
        data = b"\n".join(rnd.choice([b"", b"caf\xc3\xa9 \xff\xe2\x82 x", b"short\r", b"l" * rnd.randint(0, 400)]) for _ in range(300))
        data += rnd.choice([b"", b"\n"])
        ends = [i + 1 for i, c in enumerate(data) if c == 10]
        cuts = sorted(set(rnd.sample(range(1, len(data)), 20) + rnd.sample(ends, 10)))
        folder = tmp_path / f"z{k}"
        folder.mkdir()
        (folder / "a.zst").write_bytes(compress(data, cuts))
        (folder / "b.zst").write_bytes(zstandard.ZstdCompressor().compress(b"only\none frame"))
        (folder / "c.zst").write_bytes(b"")
        want = data.decode(errors="ignore").split("\n")
        want = sorted((want[:-1] if want[-1] == "" else want) + ["only", "one frame"])
        got = read_zstd_lines(spark, str(folder), split_bytes=1)
        assert got.rdd.getNumPartitions() == len(cuts) + 2  # a task a frame
        assert lines_of(got) == want
        assert lines_of(read_zstd_lines(spark, str(folder))) == want


def test_plain_lines_drop_broken_bytes(spark, tmp_path):
    data = b"good \xef\xbf\xbd kept\nbad \xff\xe2\x82 \xc3\xa9\xf0\x80\x80A \xed\xa0\x80 \xf4\x90\x80\x80 \xc0\xaf end\n\xf0\x9f\x98\x80"
    (tmp_path / "x.txt").write_bytes(data)
    assert lines_of(read_lines(spark, str(tmp_path / "x.txt"))) == sorted(data.decode(errors="ignore").split("\n"))


def test_zstd_through_read_lines(spark, tmp_path):
    (tmp_path / "x.zst").write_bytes(zstandard.ZstdCompressor().compress(b"a\xff\nB"))
    assert lines_of(read_lines(spark, str(tmp_path / "x.zst"), lambda c: F.upper(c))) == ["A", "B"]


def test_generators(spark, tmp_path):
    def squares(i, k):
        for n in range(i, 1000, k):
            yield {"b": n * n, "a": n}
    got = read_any(spark, squares, "a long, b long", splits=7)
    assert got.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, got.collect())) == [(n, n * n) for n in range(1000)]
    assert [tuple(r) for r in from_generator(spark, lambda: iter([(1, "x"), (2, None)]), "a int, b string").collect()] == [(1, "x"), (2, None)]
    assert sorted(r.a for r in from_generator(spark, lambda f: [(f + "!",)], "a string", splits=["p", "q"]).collect()) == ["p!", "q!"]
    assert from_generator(spark, lambda x: [], "a int", splits=[]).count() == 0


def test_a_failed_split_is_read_again(tmp_path):
    """In a cluster of its own, as one task failure ends a local session's job."""
    import subprocess
    import sys
    code = f"""
import os, sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from tokenloom.session import build_session
from tokenloom.sources.partitioned import from_generator
spark = build_session(master="local[2, 3]", shuffle_partitions=2)
def flaky(i, k):
    for n in range(10):
        if i == 1 and n == 5 and not os.path.exists({str(tmp_path / 'failed')!r}):
            open({str(tmp_path / 'failed')!r}, "w").close()
            raise OSError("lost")
        yield (i, n)
print("ROWS", sorted(map(tuple, from_generator(spark, flaky, "i int, n int", splits=3).collect())) == [(i, n) for i in range(3) for n in range(10)])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "ROWS True" in out.stdout and (tmp_path / "failed").exists(), out.stderr[-2000:]


def test_csv_types(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    assert dict(read_any(spark, str(tmp_path / "x.csv")).dtypes) == {"a": "int", "b": "string"}


def test_token_files(spark, tmp_path):
    docs = spark.range(400).select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 37), lambda x: (x * 7 + F.col("id")).cast("int"))
                                   .alias("input_ids"))
    packed = pack_sequences(docs, 64, "id", eos_id=65535)
    path = str(tmp_path / "tokens")
    write_token_files(packed, path, 64, files=5)
    names = sorted(f for f in os.listdir(path) if f[0].isdigit())
    assert len({f.split(".")[0] for f in names}) >= 3 and int(names[0].split(".")[0]) == 0
    rows = sorted((r.chunk, list(r.input_ids), list(r.attention_mask)) for r in packed.collect())
    flat = np.concatenate([r[1] for r in rows])
    assert b"".join(open(f"{path}/{f}", "rb").read() for f in names if f.endswith(".ids")) == flat.astype("<u2").tobytes()
    assert b"".join(open(f"{path}/{f}", "rb").read() for f in names if f.endswith(".mask")) == b"\x01" * len(flat)
    back = read_token_files(spark, path, split_tokens=640).collect()
    assert sorted((r.pos // 64, r.input_ids, r.attention_mask) for r in back) == rows
    longer = read_token_files(spark, path, seq_len=100).collect()
    assert [x for r in sorted(longer) for x in r.input_ids] == flat.tolist()
    assert len(os.listdir(f"{path}/_temporary")) == 0
    write_token_files(packed.where("chunk < 2"), path, 64, dtype="uint32")  # overwrites
    assert sum(len(r.input_ids) for r in read_token_files(spark, path).collect()) == 128
    with pytest.raises(Exception, match="outside 0..255"):
        write_token_files(packed, str(tmp_path / "narrow"), 64, dtype="uint8")
    assert not os.path.exists(tmp_path / "narrow" / "_manifest.json")
    write_token_files(packed.where("chunk < 4"), path, 64, files=2)
    os.remove(f"{path}/{sorted(f for f in os.listdir(path) if f.endswith('.mask'))[-1]}")
    with pytest.raises(Exception):
        read_token_files(spark, path).collect()
