"""One mechanism for sources that Spark's built-in readers don't cover: a list of parts, each read by one task through a
generator that can be started again.

``read_parts`` turns (schema, parts, read) into a Python data source. Three readers use it: A3 ``from_generator`` (a user's
callable), A1 ``read_zstd_lines`` (lines of zstd files, split at independent frames) and the token files of ``token_files``.
Files are opened through ``pyarrow.fs``, so a path may name any store it knows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BATCH_ROWS = 4096


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Part(InputPartition):
    def __init__(self, value: Any):
        self.value = value


def read_parts(spark: SparkSession, schema: str, parts: Iterable[Any], read: Callable[[Any], Iterator]) -> DataFrame:
    """A frame whose partitions are ``read(part)`` for each part; ``read`` yields tuples or Arrow batches.

    A task that fails, or whose executor is lost, calls ``read`` anew for its part. ``read`` and the parts travel to the tasks, so
    parts should be small descriptions (a path and a range), not data.
    """
    name, given = f"tokenloom_{uuid.uuid4().hex}", list(parts)

    class Reader(DataSourceReader):
        def partitions(self):
            return [Part(p) for p in given]

        def read(self, partition):
            yield from read(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    if not given:
        return spark.createDataFrame([], schema)
    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def from_generator(spark: SparkSession, fn: Callable, schema: str, *, splits: int | Iterable[Any] = 1) -> DataFrame:
    """A3 with a callable source: the rows (tuples, or dicts by column name) that ``fn`` yields.

    ``splits`` is a number k, for ``fn(i, k)`` with i from 0, or any list of arguments, for ``fn(x)`` each; one task and one
    generator a split. With the default ``fn()`` is called once.
    """
    if isinstance(splits, int):
        calls = [()] if splits == 1 else [(i, splits) for i in range(splits)]
    else:
        calls = [(x,) for x in splits]
    names = spark.createDataFrame([], schema).columns

    def rows(args: tuple) -> Iterator[tuple]:
        for r in fn(*args):
            yield tuple(r.get(c) for c in names) if isinstance(r, dict) else tuple(r)
    return read_parts(spark, schema, calls, rows)


MAGIC, SKIPPABLE = 0xFD2FB528, 0x184D2A50  # fixed values of the format


def zstd_frames(f, at: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of the frames of an open zstd file from byte ``at``: only headers are read, blocks skipped by their length."""
    size = f.size()
    while at < size:
        f.seek(at)
        head = f.read(8)
        magic = struct.unpack("<I", head[:4])[0]
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + struct.unpack("<I", head[4:8])[0]
            continue
        if magic != MAGIC:
            raise ValueError(f"no zstd frame at byte {at}")
        kind = head[4]
        single = kind >> 5 & 1
        pos = at + 5 + (1 - single) + (0, 1, 2, 4)[kind & 3] + (single, 2, 4, 8)[kind >> 6]
        last = 0
        while not last:
            f.seek(pos)
            b = int.from_bytes(f.read(3), "little")
            last = b & 1
            pos += 3 + (1 if b >> 1 & 3 == 1 else b >> 3)
            if pos > size:
                raise ValueError(f"the frame at byte {at} is cut off")
        pos += 4 * (kind >> 2 & 1)
        yield at, pos
        at = pos


def _unpacked(f, start: int, end: int, window: int, chunk: int = 1 << 22) -> Iterator[tuple[bytes, bool]]:
    """Decompressed pieces from the frame at ``start`` on, and whether each is of a frame before ``end``."""
    for a, b in zstd_frames(f, start):
        f.seek(a)
        d, left = zstandard.ZstdDecompressor(max_window_size=window).decompressobj(), b - a
        while left:
            packed = f.read(min(chunk, left))
            left -= len(packed)
            out = d.decompress(packed)
            if out:
                yield out, a < end


def _lines_of(pieces: Iterator[tuple[bytes, bool]], skipping: bool) -> Iterator[bytes]:
    """The lines that begin in a split or right at its end, of (piece, own): a split but a file's first leaves out its first
    line, which the one before it has read on for."""
    rest: list[bytes] = []
    for piece, own in pieces:
        if not own:
            if skipping:
                return
            head, end, _ = piece.partition(b"\n")
            rest.append(head)
            if end:
                yield b"".join(rest)
                return
            continue
        parts = piece.split(b"\n")
        if skipping:
            if len(parts) == 1:
                continue
            del parts[0]
            skipping = False
        if len(parts) > 1:
            yield b"".join(rest) + parts[0]
            yield from parts[1:-1]
            rest = []
        rest.append(parts[-1])
    if not skipping and any(rest):
        yield b"".join(rest)


def read_zstd_lines(spark: SparkSession, path: str | list[str], *, split_bytes: int = 64 << 20, window: int = 1 << 30) -> DataFrame:
    """A1: (line) of zstd files (a path, folder, pattern or list of them), byte for byte: lines end at a line feed only, bytes
    that aren't UTF-8 are dropped, a last line without an end is kept.

    One job looks up where the frames of each file begin (headers only); a task then reads the frames of about ``split_bytes``,
    so a file written as many independent frames is read by many tasks, one of a single frame by one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def look(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for p, length in zip(b["path"], b["length"], strict=True):
                if not length:
                    continue
                system, inner = file_system(p)
                with system.open_input_file(inner) as f:
                    start = None
                    for a, z in zstd_frames(f):
                        start = a if start is None else start
                        if z - start >= split_bytes:
                            rows.append((p, start, z))
                            start = None
                    if start is not None:
                        rows.append((p, start, z))
            yield pd.DataFrame(rows, columns=["path", "start", "end"])

    dealt = files.repartition(spark.sparkContext.defaultParallelism)
    # one row a split, as Spark's own file listing has
    splits = [tuple(r) for r in dealt.mapInPandas(look, "path string, start long, end long").collect()]
    first = {}
    for p, start, _ in splits:
        first[p] = min(start, first.get(p, start))

    def read(part) -> Iterator[pa.RecordBatch]:
        p, start, end, is_first = part
        system, inner = file_system(p)
        with system.open_input_file(inner) as f:
            batch: list[str] = []
            for line in _lines_of(_unpacked(f, start, end, window), not is_first):
                batch.append(line.decode("utf-8", "ignore"))
                if len(batch) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], ["line"])
                    batch = []
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], ["line"])

    return read_parts(spark, "line string", [(*s, s[1] == first[s[0]]) for s in splits], read)


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class ZstdLinesWriter(DataSourceArrowWriter):
    """A file a task, an independent frame a batch; the files get their names when the job commits."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        system, base = file_system(self.path)
        system.create_dir(f"{base}/_temporary", recursive=True)
        name = f"{base}/_temporary/{uuid.uuid4().hex}"
        with system.open_output_stream(name) as f:
            for b in iterator:
                lines = (x for x in b.column(0).to_pylist() if x is not None)
                f.write(zstandard.ZstdCompressor(write_checksum=True).compress("".join(x + "\n" for x in lines).encode()))
        return _Files([name])

    def commit(self, messages: list[_Files | None]) -> None:
        system, base = file_system(self.path)
        for i, name in enumerate(n for m in messages if m for n in m.names):
            system.move(name, f"{base}/part-{i:05d}-{uuid.uuid4().hex[:8]}.zst")

    def abort(self, messages: list[_Files | None]) -> None:
        system, _ = file_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(name)


class ZstdLines(DataSource):
    """Data source ``zstd_lines``: option path."""

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> ZstdLinesWriter:
        return ZstdLinesWriter(self.options["path"])


def write_zstd_lines(df: DataFrame, path: str) -> None:
    """The one text column of ``df`` as zstd files of independent frames, which ``read_zstd_lines`` can split; null rows are left out."""
    df.sparkSession.dataSource.register(ZstdLines)
    lines = df.toDF("line").select(F.col("line").cast("string").alias("line"))
    lines.write.format("zstd_lines").mode("append").option("path", path).save()
