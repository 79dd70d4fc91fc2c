"""Every (overlapping) occurrence of token patterns in token sequences.

Single pattern inside a row: ``find_in_row`` (array filter over start positions).
Many patterns x a large corpus: ``find_subsequences``. Its distinct patterns are counted first (one aggregate). As long as they
hold at most ``AUTOMATON_TOKENS`` tokens, they are made into one automaton with failure links that every task
builds once from a broadcast of that size; it reads each sequence once, inside its row, and only hits leave the
scan: (pattern hash, document, position). Beyond that bound ``find_by_anchors`` takes over: an equi-join on anchor n-grams, with
no bound on the pattern set, verified against the real tokens. Both are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import col_

#: Tokens of all distinct patterns up to which they travel as one automaton (some tens of MB of it a Python worker).
AUTOMATON_TOKENS = 500_000
SEP, ESCAPE = "\x1f", "\x1e"


def find_in_row(seq, pattern, first_only: bool = False) -> Column:
    """C5 for one pattern per row: 0-based start positions (guarded: no hits when the sequence is shorter)."""
    s, p = col_(seq), col_(pattern)
    n, m = F.size(s), F.size(p)
    hits = F.filter(F.sequence(F.lit(0), n - m), lambda i: F.slice(s, i + 1, m) == p)
    hits = F.when((m > 0) & (n >= m), hits).otherwise(F.array().cast("array<int>"))
    return F.slice(hits, 1, 1) if first_only else hits


def _written(tokens: Column) -> Column:
    """Tokens as one text, each after a separator, and one at the end; equal only for equal tokens."""
    def escaped(t: Column) -> Column:
        return F.replace(F.replace(t, F.lit(ESCAPE), F.lit(ESCAPE + "a")), F.lit(SEP), F.lit(ESCAPE + "b"))
    each = F.transform(tokens, lambda t: F.concat(F.lit(SEP), F.coalesce(escaped(t.cast("string")), F.lit(ESCAPE + "n"))))
    return F.concat(F.array_join(each, ""), F.lit(SEP))


def _joined(lists: pa.Array) -> pa.Array:
    """As ``_written`` for an Arrow array of lists."""
    flat = pc.cast(lists.flatten(), pa.string())
    if flat.null_count or pc.any(pc.match_substring_regex(flat, f"[{ESCAPE}{SEP}]")).as_py():
        flat = pc.replace_substring(pc.replace_substring(flat, ESCAPE, ESCAPE + "a"), SEP, ESCAPE + "b")
        flat = pc.fill_null(flat, ESCAPE + "n")
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy())]), pa.int32())
    body = pc.binary_join_element_wise("", pc.binary_join(pa.ListArray.from_arrays(offsets, flat), SEP), "", SEP)
    return pc.if_else(pc.greater(sizes, 0), body, pa.scalar(None, pa.string()))


def find_subsequences(corpus: DataFrame, patterns: DataFrame, *, doc_id: str = "doc_id", tokens: str = "tokens",
                      pattern_id: str = "item_id", pattern: str = "pattern", anchor: int = 8,
                      anchor_lengths: list[int] | None = None, first_only: bool = False,
                      automaton_tokens: int = AUTOMATON_TOKENS) -> DataFrame:
    """All occurrences ``(pattern_id, doc_id, pos)`` of every pattern in every token sequence.

    Empty patterns, and those that hold a NULL token, have no hits. Equal patterns are searched once. ``anchor`` and ``anchor_lengths``
    are for pattern sets beyond ``automaton_tokens`` (see ``find_by_anchors``).
    """
    pats = patterns.select(F.col(pattern_id).alias("pid"), F.col(pattern).alias("pat"))
    pats = pats.where((F.size("pat") > 0) & ~F.exists("pat", lambda t: t.isNull()))
    distinct = pats.select("pat").distinct()
    total = distinct.agg(F.sum(F.size("pat"))).first()[0] or 0
    if total > automaton_tokens:
        hits = find_by_anchors(corpus, pats, doc_id=doc_id, tokens=tokens, pattern_id="pid", pattern="pat", anchor=anchor,
                               anchor_lengths=anchor_lengths)
    else:
        hits = _find_by_automaton(corpus, distinct, doc_id, tokens).join(
            pats.select("pid", *_pattern_key(_written(F.col("pat")))), ["h1", "h2"]).select("pid", doc_id, "pos")
    out = hits.withColumnRenamed("pid", pattern_id)
    if first_only:
        out = out.groupBy(pattern_id, doc_id).agg(F.min("pos").alias("pos"))
    return out


def _pattern_key(written: Column) -> list[Column]:
    return [F.xxhash64(written).alias("h1"), F.xxhash64(F.lit(7), written).alias("h2")]


def _find_by_automaton(corpus: DataFrame, distinct: DataFrame, doc_id: str, tokens: str) -> DataFrame:
    """(h1, h2, doc_id, pos) of every hit of a measured, bounded set of patterns."""
    spark = corpus.sparkSession
    rows = distinct.select(_written(F.col("pat")).alias("w")).select("w", *_pattern_key(F.col("w"))).collect()
    shared = spark.sparkContext.broadcast([(r.w, r.h1, r.h2) for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, (w, _, _) in enumerate(shared.value):
            automaton.add_word(w, (k, len(w)))
        if not shared.value:
            return
        automaton.make_automaton()
        keys = np.array([(h1, h2) for _, h1, h2 in shared.value], np.int64)
        for b in batches:
            which, row, at = [], [], []
            for i, text in enumerate(_joined(b.column(1)).to_pylist()):
                found = list(automaton.iter(text)) if text is not None else None
                if found:
                    starts = np.array([end - n + 1 for end, (_, n) in found])
                    marks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == ord(SEP))
                    which += [k for _, (k, _) in found]
                    row += [i] * len(found)
                    at.append(np.searchsorted(marks, starts))
            if row:
                pos = pa.array(np.concatenate(at).astype(np.int32))
                cols = [pa.array(keys[which, 0]), pa.array(keys[which, 1]), b.column(0).take(pa.array(row)), pos]
                yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", doc_id, "pos"])

    docs = corpus.select(doc_id, tokens)
    return docs.mapInArrow(search, f"h1 long, h2 long, `{doc_id}` {dict(docs.dtypes)[doc_id]}, pos int")


def find_by_anchors(corpus: DataFrame, patterns: DataFrame, *, doc_id: str = "doc_id", tokens: str = "tokens",
                    pattern_id: str = "item_id", pattern: str = "pattern", anchor: int = 8,
                    anchor_lengths: list[int] | None = None) -> DataFrame:
    """The occurrences of a pattern set of any size: every pattern's anchor is the hash of its first
    ``min(anchor, len)`` tokens, every corpus position has the hash of the n-gram that starts there (only ``doc_id, pos, hash``
    travel), the two meet in an equi-join, and candidates are verified against the real tokens.

    The distinct anchor lengths (one pass over the corpus positions each) are read from the
    patterns with one tiny aggregate (at most ``anchor`` values); ``anchor_lengths`` can only add to them, so no
    pattern is skipped.
    """
    pats = (patterns.select(F.col(pattern_id).alias("pid"), F.col(pattern).alias("pat"))
            .where(F.size("pat") > 0)
            .withColumn("a", F.least(F.size("pat"), F.lit(anchor)))
            .withColumn("h", F.xxhash64(F.slice("pat", 1, F.col("a")))))
    # At most ``anchor`` distinct small integers: the shape of the plan, not data.
    found = [r[0] for r in pats.select("a").distinct().collect()]
    lengths = sorted({*found, *(anchor_lengths or ())}) or [anchor]
    docs = corpus.select(F.col(doc_id).alias("doc"), F.col(tokens).alias("toks"))
    cands = None
    for a in lengths:
        n = F.size("toks")
        pos = docs.select("doc", F.explode(
            F.when(n >= a, F.transform(F.sequence(F.lit(0), n - a),
                                       lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("toks", i + 1, a)).alias("h"))))
        ).alias("x")).select("doc", "x.pos", "x.h")
        c = pos.join(pats.where(F.col("a") == a).select("pid", "h", "pat"), "h").select("pid", "doc", "pos", "pat")
        cands = c if cands is None else cands.unionByName(c)
    return (cands.join(docs, "doc")
            .where(F.slice("toks", F.col("pos") + 1, F.size("pat")) == F.col("pat"))
            .select(F.col("pid").alias(pattern_id), F.col("doc").alias(doc_id), "pos"))
