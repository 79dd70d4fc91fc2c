"""The token stream as binary files of fixed width, and its reader.

A packed row of ``seq_len`` tokens stands at position ``chunk * seq_len`` of the stream. Rows are range-partitioned by chunk
(rows travel, not tokens), each task writes consecutive ones to files that are named by the position of
their first token, ``<start>.ids`` (uint8, uint16 or uint32, little-endian) and ``<start>.mask`` (uint8), so the files in name
order are the two flat arrays. Tasks write under temporary names; the commit gives the files of the tasks that succeeded
their names and adds ``_manifest.json``. An id or mask value above its width fails the job, and nothing is committed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tokenloom.sources.partitioned import file_system, read_parts

WIDTHS = {"uint8": "<u1", "uint16": "<u2", "uint32": "<u4"}
MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]] = field(default_factory=list)  # (temporary name, first position, tokens)


def _narrow(values: np.ndarray, dtype: str, what: str) -> bytes:
    most = np.iinfo(WIDTHS[dtype]).max
    if len(values) and (values.min() < 0 or values.max() > most):
        raise ValueError(f"{what} outside 0..{most}")
    return values.astype(WIDTHS[dtype]).tobytes()


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str, seq_len: int, overwrite: bool):
        self.path, self.dtype, self.seq_len, self.overwrite = path.rstrip("/"), dtype, seq_len, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = file_system(self.path)
        system.create_dir(f"{base}/_temporary", recursive=True)
        done, open_, at = Written(), None, -1
        for b in iterator:
            starts = b.column(0).to_numpy(zero_copy_only=False) * self.seq_len
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            if (b.column(2).value_lengths().to_numpy(zero_copy_only=False) != sizes).any():
                raise ValueError("ids and masks differ in length")
            ids = _narrow(b.column(1).flatten().to_numpy(zero_copy_only=False), self.dtype, "token id")
            mask = _narrow(b.column(2).flatten().to_numpy(zero_copy_only=False), "uint8", "mask value")
            width = np.dtype(WIDTHS[self.dtype]).itemsize
            begins = np.concatenate([[0], np.cumsum(sizes)])
            cuts = [k for k in range(len(starts)) if starts[k] != (starts[k - 1] + sizes[k - 1] if k else at)]
            for lo, hi in zip([0, *[k for k in cuts if k]], [*[k for k in cuts if k], len(starts)], strict=True):
                if lo in cuts or open_ is None:
                    self._close(open_, done)
                    name = f"{base}/_temporary/{uuid.uuid4().hex}"
                    open_ = (name, int(starts[lo]), system.open_output_stream(name + ".ids"), system.open_output_stream(name + ".mask"))
                open_[2].write(ids[begins[lo] * width:begins[hi] * width])
                open_[3].write(mask[begins[lo]:begins[hi]])
                at = int(starts[hi - 1] + sizes[hi - 1])
            if open_:
                open_ = (*open_[:4], at)
        self._close(open_, done)
        return done

    @staticmethod
    def _close(open_, done: Written) -> None:
        if open_ is not None:
            name, start, ids, mask, end = open_
            ids.close()
            mask.close()
            done.files.append((name, start, end - start))

    def commit(self, messages: list[Written | None]) -> None:
        system, base = file_system(self.path)
        old = [] if not self._there(system, base, MANIFEST) else json.loads(_read(system, f"{base}/{MANIFEST}"))["files"]
        if old and not self.overwrite:
            raise ValueError(f"{self.path} holds a token stream already")
        if old:
            system.delete_file(f"{base}/{MANIFEST}")
        for start, _ in old:
            for kind in ("ids", "mask"):
                system.delete_file(f"{base}/{start:020d}.{kind}")
        files = sorted((start, n, name) for m in messages if m for name, start, n in m.files)
        for (start, n, _), (after, _, _) in zip(files, files[1:]):
            if start + n > after:
                raise ValueError(f"tokens {after} to {start + n} are there twice")
        for start, _, name in files:
            for kind in ("ids", "mask"):
                system.move(f"{name}.{kind}", f"{base}/{start:020d}.{kind}")
        with system.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps({"dtype": self.dtype, "seq_len": self.seq_len, "files": [[s, n] for s, n, _ in files]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            for name, _, _ in m.files if m else ():
                for kind in ("ids", "mask"):
                    system.delete_file(f"{name}.{kind}")

    @staticmethod
    def _there(system: fs.FileSystem, base: str, name: str) -> bool:
        return system.get_file_info(f"{base}/{name}").type == fs.FileType.File


class TokenSink(DataSource):
    """Data source ``token_files``: options path, dtype, seq_len."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "chunk long, input_ids array<int>, attention_mask array<int>"

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], self.options["dtype"], int(self.options["seq_len"]), overwrite)


def _read(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


def write_token_files(packed: DataFrame, path: str, seq_len: int, *, dtype: str = "uint16", chunk: str = "chunk",
                      ids: str = "input_ids", mask: str = "attention_mask", files: int | None = None) -> None:
    """Write packed rows (chunk, ids, mask) as the flat token stream. ``files``: about how many; else as many as the session's
    shuffle partitions. Only the last chunk may be shorter than ``seq_len``."""
    if dtype not in WIDTHS:
        raise ValueError(f"unknown width {dtype!r}")
    spark = packed.sparkSession
    spark.dataSource.register(TokenSink)
    rows = packed.select(F.col(chunk).cast("long").alias("chunk"), F.col(ids).alias("input_ids"), F.col(mask).alias("attention_mask"))
    rows = rows.repartitionByRange(files, "chunk") if files else rows.repartitionByRange("chunk")
    (rows.sortWithinPartitions("chunk").write.format("token_files").mode("overwrite")
     .option("path", path).option("dtype", dtype).option("seq_len", str(seq_len)).save())


def read_token_files(spark: SparkSession, path: str, *, seq_len: int | None = None, split_tokens: int = 1 << 22) -> DataFrame:
    """(pos, input_ids, attention_mask): the stream in rows of ``seq_len`` tokens (as written, by default). Fails if a file of the
    manifest is missing, of another size, or if positions are."""
    system, base = file_system(path.rstrip("/"))
    made = json.loads(_read(system, f"{base}/{MANIFEST}"))
    dtype, length = np.dtype(WIDTHS[made["dtype"]]), seq_len or made["seq_len"]
    at = 0
    for start, n in made["files"]:
        if start != at:
            raise ValueError(f"tokens {at} to {start} are missing")
        at += n
    total, step = at, max(length, split_tokens // length * length)
    parts = [(lo, min(lo + step, total)) for lo in range(0, total, step)]

    def between(lo: int, hi: int, kind: str, item: np.dtype) -> np.ndarray:
        out = []
        for start, n in made["files"]:
            a, b = max(lo, start), min(hi, start + n)
            if a < b:
                with system_of().open_input_file(f"{base}/{start:020d}.{kind}") as f:
                    if f.size() != n * item.itemsize:
                        raise ValueError(f"{start:020d}.{kind} has {f.size()} bytes, not {n * item.itemsize}")
                    f.seek((a - start) * item.itemsize)
                    out.append(np.frombuffer(f.read((b - a) * item.itemsize), item))
        return np.concatenate(out)

    def system_of() -> fs.FileSystem:
        return file_system(path)[0]

    def read(part) -> Iterator[pa.RecordBatch]:
        lo, hi = part
        ids, mask = between(lo, hi, "ids", dtype), between(lo, hi, "mask", np.dtype("<u1"))
        starts = np.arange(0, hi - lo, length)
        offsets = pa.array(np.append(starts, hi - lo).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts + lo), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))),
             pa.ListArray.from_arrays(offsets, pa.array(mask.astype(np.int16)))], ["pos", "input_ids", "attention_mask"])

    return read_parts(spark, "pos long, input_ids array<long>, attention_mask array<short>", parts, read)
