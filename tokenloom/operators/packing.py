"""E1 sequence packing and A11 flat token-stream sink.

Packing is set-based: every document's ``ids + [eos]`` gets a global start
offset from the two-level prefix sum (E2). A document overlaps chunks
``off div L .. (off+n-1) div L``; it is cut into one slice per overlapped chunk
(rows = documents + chunks, not tokens), and slices are reassembled per chunk.
A chunk never holds more than L tokens, so no group is unbounded. The
incomplete tail chunk is dropped, as is the reference behaviour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.checks import allow_only, assert_true, require_columns
from tokenloom.operators.ordering import prefix_sum

# End-of-sequence and padding token ids used by the tokenisation step.
EOS_ID = 100257
PAD_ID = 100277


def pack_sequences(df: DataFrame, max_seq_len: int, order: Sequence[str] | str, *, eos_id: int = EOS_ID,
                   ids: str = "input_ids", attention: str | None = None, shard_col: str | None = None,
                   keep_tail: bool = False, strict_columns: bool = False,
                   ties: bool = False) -> DataFrame:
    """Concatenate ``ids + [eos]`` in order, cut every ``max_seq_len``.

    Output ``[shard,] chunk, input_ids, attention_mask``. ``shard_col`` restarts packing
    per shard (each shard drops its own tail); ``keep_tail`` keeps incomplete chunks.
    ``strict_columns`` rejects any column besides ids, mask, order and shard (B7).
    NULL ids count as an empty document (its eos stays); a given attention mask must be as long as the ids.
    The prefix sum stages its input, so an expensive upstream step such as tokenisation runs once. Without a given
    mask none travels: the all-ones mask is made after the chunks are put together.
    """
    if max_seq_len < 1:
        raise ValueError("max_seq_len must be >= 1")
    if eos_id is None:
        raise ValueError("an eos id is required")
    order = [order] if isinstance(order, str) else list(order)
    part = [shard_col] if shard_col else []
    needed = order + part + [ids] + ([attention] if attention else [])
    require_columns(df, needed, "pack_sequences input")
    if strict_columns:
        allow_only(df, needed, "pack_sequences input")
    L = max_seq_len
    given = F.coalesce(F.col(ids), F.array().cast(dict(df.dtypes)[ids]))
    cols = [F.concat(given, F.array(F.lit(eos_id))).alias("_seq")]
    if attention:
        mask = F.coalesce(F.col(attention), F.array().cast(dict(df.dtypes)[attention]))
        mask = F.when(assert_true(F.size(mask) == F.size(given), f"{attention} and {ids} differ in length"), mask)
        cols.append(F.concat(mask, F.array(F.lit(1))).alias("_msk"))
    x = df.select(*part, *order, *cols).withColumn("_n", F.size("_seq"))
    x = prefix_sum(x, order, "_n", partition=part, start_col="_off", total_col=None, ties=ties)
    off, n = F.col("_off"), F.col("_n")
    x = x.select(*part, "_off", "_n", "_seq", *(["_msk"] if attention else []),
                 F.explode(F.sequence(F.floor(off / L), F.floor((off + n - 1) / L))).alias("chunk"))
    lo = F.greatest(F.col("chunk") * L, off)
    hi = F.least((F.col("chunk") + 1) * L, off + n)
    at, size = (lo - off + 1).cast("int"), (hi - lo).cast("int")
    piece = [lo.alias("at"), F.slice("_seq", at, size).alias("ids")]
    piece += [F.slice("_msk", at, size).alias("mask")] if attention else []
    pieces = x.select(*part, "chunk", F.struct(*piece).alias("p"))
    g = pieces.groupBy(*part, "chunk").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    g = g.select(*part, "chunk", F.flatten(F.col("ps.ids")).alias("input_ids"),
                 *([F.flatten(F.col("ps.mask")).alias("attention_mask")] if attention else []))
    if not attention:
        g = g.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    if not keep_tail:
        g = g.where(F.size("input_ids") == L)
    return g


def flat_token_stream(packed: DataFrame, max_seq_len: int, *, chunk: str = "chunk", ids: str = "input_ids",
                      mask: str = "attention_mask", max_id: int | None = None) -> DataFrame:
    """Long table ``pos, token_id, mask`` with ``pos = chunk * max_seq_len + i``.

    ``max_id`` range-checks ids for narrow sinks (65535 for uint16) and fails the job if exceeded.
    """
    z = packed.select(F.col(chunk).alias("_c"), F.posexplode(F.arrays_zip(F.col(ids).alias("t"),
                                                                        F.col(mask).alias("m"))))
    out = z.select((F.col("_c") * max_seq_len + F.col("pos")).cast("long").alias("pos"),
                   F.col("col.t").alias("token_id"), F.col("col.m").cast("short").alias("mask"))
    if max_id is not None:
        out = out.where(assert_true((F.col("token_id") >= 0) & (F.col("token_id") <= max_id),
                                    f"token id outside 0..{max_id}"))
    return out


def write_token_stream(stream: DataFrame, path: str, rows_per_file_block: int = 1 << 24) -> None:
    """A11 sink: range-partitioned Parquet by ``pos`` so files hold contiguous positions."""
    (stream.withColumn("block", F.floor(F.col("pos") / rows_per_file_block))
     .repartitionByRange("block", "pos").sortWithinPartitions("pos")
     .write.mode("overwrite").partitionBy("block").parquet(path))
