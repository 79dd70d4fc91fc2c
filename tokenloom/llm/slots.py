"""Sharding through fixed virtual slots (DataFrame operations only).

A record is hashed, by its key and its text, into one of a few thousand slots, for ever; identical records are numbered
and the number is hashed too, so neither a common (or missing) key nor a common record fills a slot. The numbering counts
them in chunks of ``CHUNK`` rows as they are read and adds the counts of the chunks before: the rows of a record never meet
in one task, and the numbers are 0, 1, ... however the rows are read. Bytes and rows are summed by slot, and a
small table maps slots to shards. That table is versioned: version 1 deals the slots out evenly, a rebalancing
copies the newest version and edits it (moves single slots), and adding a shard only moves slots into the new one.
Records never move but with their slot. The law is `bytes`: after rebalancing the shards' bytes are near equal.

All that reaches the driver is one row a slot (``slots`` rows, whatever the corpus). Defined cases: a null text
has no bytes (size 1 with the separator); a null key is a key like any other; rows with equal keys but different
texts, and equal rows, are spread over the slots; an empty table gives an empty result and an even map. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import scratch_path, staged

SLOTS = 4096
CHUNK_BITS = 12  # a chunk: 4096 rows, one after the other in a partition


def virtual_slot(key: list[str], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def record_size(text: str) -> Column:
    """UTF-8 bytes of the text plus one for a separator."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shard of every slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, tuple(s * shards // slots for s in range(slots)))

    def loads(self, size: list[int]) -> list[int]:
        out = [0] * self.shards
        for s, b in zip(self.shard_of, size, strict=True):
            out[s] += b
        return out

    def rebalanced(self, size: list[int], tolerance: float = 0.0005) -> SlotMap:
        """The next version: slots move one at a time from the fullest to the emptiest shard, each time the slot
        nearest to half their difference, until that is within ``tolerance`` of the mean or no move helps."""
        return self._levelled(size, self.shards, tolerance, only_into=None)

    def grown(self, size: list[int], tolerance: float = 0.0005) -> SlotMap:
        """The next version with one more shard: slots move only into the new one, from the fullest, to an even share."""
        return self._levelled(size, self.shards + 1, tolerance, only_into=self.shards)

    def _levelled(self, size, shards, tolerance, only_into) -> SlotMap:
        shard_of = list(self.shard_of)
        held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        load = [0] * shards
        for s, b in enumerate(size):
            insort(held[shard_of[s]], (b, s))
            load[shard_of[s]] += b
        enough = tolerance * sum(size) / shards
        while True:
            top = max(range(shards), key=lambda i: (load[i], -i))
            low = only_into if only_into is not None else min(range(shards), key=lambda i: (load[i], i))
            gap = load[top] - load[low]
            if gap <= enough:
                break
            i = bisect_left(held[top], (gap / 2, -1))
            near = [x for x in held[top][max(0, i - 1): i + 1] if 0 < x[0] < gap]
            if not near:
                break
            b, s = min(near, key=lambda x: (abs(x[0] - gap / 2), x))
            held[top].remove((b, s))
            insort(held[low], (b, s))
            load[top] -= b
            load[low] += b
            shard_of[s] = low
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def table(self, spark: SparkSession, size: list[int], rows: list[int]) -> DataFrame:
        """One row a slot: version, vslot, shard, bytes, rows and the place of its first record within its shard."""
        start, at = [], [0] * self.shards
        for s, n in zip(self.shard_of, rows, strict=True):
            start.append(at[s])
            at[s] += n
        i = F.col("id").cast("int")

        def of(values) -> Column:  # a literal list, read by place: no Python rows enter the plan
            return F.get(F.split(F.lit(",".join(map(str, values))), ","), i).cast("long")

        return spark.range(len(self.shard_of), numPartitions=1).select(
            F.lit(self.version).alias("version"), i.alias("vslot"), of(self.shard_of).cast("int").alias("shard"),
            of(size).alias("bytes"), of(rows).alias("rows"), of(start).alias("start"))


def records(docs: DataFrame, *, key: list[str], text: str, slots: int = SLOTS) -> DataFrame:
    """(key columns, size, text_crc32, vslot) of every row, staged: the text is read once."""
    rows = docs.select(*key, record_size(text).alias("size"),
                       F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("__th"),
                       F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS).alias("__chunk"))
    same = F.concat_ws("\0", F.to_json(F.struct(*key)), *[F.col(c).cast("string") for c in ("size", "text_crc32", "__th")])
    rows = staged(rows.withColumn("__same", F.md5(same.cast("binary"))).drop("__th"), "slot-rows")
    earlier = F.sum("n").over(Window.partitionBy("__same").orderBy("__chunk")
                              .rowsBetween(Window.unboundedPreceding, -1))  # one row a chunk
    chunks = rows.groupBy("__same", "__chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("__earlier", earlier)
    chunks = chunks.filter("__earlier > 0").select("__same", "__chunk", "__earlier")
    here = F.row_number().over(Window.partitionBy("__same", "__chunk").orderBy("__same")) - 1  # at most a chunk
    rows = rows.withColumn("__here", here).join(chunks, ["__same", "__chunk"], "left")
    rows = rows.withColumn("__copy", F.col("__here") + F.coalesce("__earlier", F.lit(0).cast("long")))
    return staged(rows.select(*key, "size", "text_crc32", virtual_slot(["__same", "__copy"], slots).alias("vslot")),
                  "slot-records")


def slot_totals(recs: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: one row a slot reaches the driver."""
    size, rows = [0] * slots, [0] * slots
    per = recs.groupBy(F.col("vslot").alias("v")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    for r in per.collect():
        size[r.v], rows[r.v] = r.b, r.n
    return size, rows


def save_map(table: DataFrame, path: str) -> None:
    """Add a version to the stored map; versions already there stay."""
    table.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    t = spark.read.parquet(path)
    v = version if version is not None else t.agg(F.max("version")).first()[0]
    return t.filter(F.col("version") == v)


def shard(docs: DataFrame, shards: int, *, key: list[str] = ("doc_id",), text: str = "text", slots: int = SLOTS,
          path: str | None = None) -> DataFrame:
    """(key columns, size, text_crc32, vslot, shard, place, map_version) of every row.

    Stores version 1 (even) and version 2 (rebalanced by bytes) of the map under ``path`` and applies the stored
    newest version. ``place`` numbers the rows of a shard without gaps: the start of the slot within its shard
    plus the row's number within the slot (a window over one slot, about 1/``slots`` of the rows).
    """
    spark, key = docs.sparkSession, list(key)
    path = path or scratch_path(spark, "slot-map")
    recs = records(docs, key=key, text=text, slots=slots)
    size, rows = slot_totals(recs, slots)
    first = SlotMap.even(shards, slots)
    save_map(first.table(spark, size, rows), path)
    save_map(first.rebalanced(size).table(spark, size, rows), path)
    newest = load_map(spark, path).select("vslot", "shard", "start", F.col("version").alias("map_version"))
    within = F.row_number().over(Window.partitionBy("vslot").orderBy(*key, "text_crc32", "size")) - 1
    recs = recs.withColumn("__n", within.cast("long"))
    return recs.join(F.broadcast(newest), "vslot").select(  # one row a slot
        *key, "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("__n")).alias("place"), "map_version")
