"""Loss-mask construction.

E6 span_segments (+ H10 severity), H11 segment_token_mask, B8 drop_unmaskable,
F4 random_token_budget, H12 zero_bad_words, C3 char_to_token, C4 mask_to_tokens.
All are array expressions inside a row (no shuffle) except the long-form
offset helpers, which use one window per document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import col_, let, py_lower_strip, token_id, ws_tokens
from tokenloom.operators.tokenize import ids_of_pieces

CUT = 1024  # characters of the pieces a text is cut into once


def severity(score, toxic_threshold: float, safe_threshold: float) -> Column:
    """``score > toxic`` -> 3, ``> safe`` -> 2, else 1."""
    s = col_(score)
    return F.when(s > toxic_threshold, 3).when(s > safe_threshold, 2).otherwise(1)


def span_segments(text, spans, toxic_threshold: float, safe_threshold: float) -> Column:
    """E6 + H10: ``array<struct<text, label>>`` from ordered ``array<struct<start, end, score>>``.

    Segment i runs from ``min(prev_end, start_i)`` to ``end_i`` (a gap joins the
    next span, an overlap repeats text); text after the last span end is one
    more segment with label 1. The text is cut into pieces of ``CUT`` characters
    once, so a segment costs its own length and not its distance from the start.
    """
    t, sp = col_(text), col_(spans)

    def seg(pieces, s, i):
        prev = F.when(i == 0, F.lit(0)).otherwise(F.get(sp, i - 1)["end"])
        lo = F.greatest(F.least(prev, s["start"]), F.lit(0))
        hi = F.greatest(s["end"], lo)
        first = F.floor(lo / CUT).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.floor(hi / CUT).cast("int") - first + 1), "")
        return F.struct(F.substring(near, lo - first * CUT + 1, hi - lo).alias("text"),
                        severity(s["score"], toxic_threshold, safe_threshold).alias("label"))

    last_end = F.coalesce(F.get(sp, F.size(sp) - 1)["end"], F.lit(0))
    tail = F.when(last_end < F.length(t), F.array(F.struct(F.substr(t, last_end + 1).alias("text"),
                                                            F.lit(1).alias("label"))))
    cut = let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)),
              lambda pieces: F.transform(sp, lambda s, i: seg(pieces, s, i)))
    spans_ = F.coalesce(cut, F.array().cast("array<struct<text:string,label:int>>"))  # NULL: no span
    return F.concat(spans_, F.coalesce(tail, F.array().cast("array<struct<text:string,label:int>>")))


def segment_token_mask(segments, fn: Callable[[list[str]], list[list[int]]] | None = None) -> tuple[Column, Column]:
    """``(input_ids, loss_mask)``: each segment's tokens, its label repeated per token.

    ``fn`` is any tokenizer of a list of texts; without it the built-in one is used.
    """
    s = col_(segments)
    if fn is not None:
        each = ids_of_pieces(fn)(F.transform(s, lambda x: x["text"]))
        labels = F.transform(s, lambda x: x["label"])
        return F.flatten(each), F.flatten(F.zip_with(each, labels, lambda i, l: F.array_repeat(l, F.size(i))))
    toks = F.transform(s, lambda x: F.struct(ws_tokens(x["text"]).alias("t"), x["label"].alias("l")))
    ids = F.flatten(F.transform(toks, lambda x: F.transform(x["t"], token_id)))
    mask = F.flatten(F.transform(toks, lambda x: F.array_repeat(x["l"], F.size(x["t"]))))
    return ids, mask


def drop_unmaskable(df: DataFrame, segments: str = "segments") -> DataFrame:
    """Drop rows whose labels sum to 0, or whose only zero label is the last one."""
    labels = F.transform(F.col(segments), lambda x: x["label"])
    total = F.aggregate(labels, F.lit(0), lambda a, x: a + x)
    last = F.get(labels, F.size(labels) - 1)
    skip = (total == 0) | ((last == 0) & (total == F.size(labels) - 1))
    return df.where(~skip)


def random_token_budget(n_tokens, fraction: float, seed, key) -> Column:
    """0/1 array of length n with exactly ``int(n * fraction)`` ones.

    Positions are ranked by ``md5('seed:key:pos')``: a sort inside the row by the
    hash, the rank taken, then a sort back to position order (O(n log n), no shuffle).
    ``key`` may be a column holding the ready ``'seed:key:'`` prefix (see ``with_token_budget``).
    """
    n = col_(n_tokens)
    k = F.floor(n * F.lit(float(fraction))).cast("int")
    pos = F.sequence(F.lit(0), n - 1)
    pre = F.concat(F.lit(f"{seed}:"), col_(key).cast("string"), F.lit(":")) if seed is not None else col_(key)
    hashed = F.transform(pos, lambda p: F.struct(F.md5(F.concat(pre, p.cast("string"))).alias("h"), p.alias("p")))
    ranked = F.transform(F.sort_array(hashed), lambda x, r: F.struct(x["p"].alias("p"), (r < k).cast("int").alias("m")))
    # The guard references ``pre`` outside the lambda too, so the optimizer keeps it a column
    # instead of inlining its expression into the per-position lambda.
    return F.when((n > 0) & pre.isNotNull(), F.transform(F.sort_array(ranked), lambda x: x["m"])).otherwise(
        F.array().cast("array<int>"))


def with_token_budget(df: DataFrame, n_tokens: str, fraction: float, seed, key: str, out: str = "mask") -> DataFrame:
    """F4 as a DataFrame step: the per-row hash prefix is materialised once, not per position."""
    x = df.withColumn("_f4pre", F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":")))
    return x.withColumn(out, random_token_budget(n_tokens, fraction, None, "_f4pre")).drop("_f4pre")


def zero_bad_words(mask, tokens, bad_words: Sequence[str]) -> Column:
    """Zero the mask where ``lower(strip(token))`` is a bad word (literal set, plan time)."""
    bad = F.array(*[F.lit(w) for w in bad_words]) if bad_words else F.array().cast("array<string>")
    t = col_(tokens)
    out = F.transform(col_(mask), lambda m, i: F.when((m == 1) & F.array_contains(bad, py_lower_strip(F.get(t, i))),
                                                       F.lit(0)).otherwise(m))
    return F.when(t.isNotNull(), out)


def char_to_token_long(offsets: DataFrame, chars: DataFrame, id_cols: Sequence[str], char_col: str = "char_index"
                       ) -> DataFrame:
    """C3 over long offsets ``(ids, token_index, start, end)``: first token containing the char,
    else the last token; ``aligned`` = the token starts exactly at the char. Chars of documents without tokens have no row.

    An as-of join: tokens (by their end) and chars are put together, sorted once per document from the end, and each char
    takes the token seen last, the first one that ends after it. Tokens must be in the order of their ends, as
    tokenizers give them; empty ones contain nothing. One sort per document, no token meets every char.
    """
    ids = list(id_cols)
    tok = F.struct("token_index", "start")
    t = offsets.select(*ids, F.col("end").alias("_p"), F.lit(1).alias("_kind"), F.col("token_index").alias("_k"),
                       F.when(F.col("end") > F.col("start"), tok).alias("_t"), tok.alias("_any"), F.lit(None).cast("int").alias(char_col))
    kind = dict(chars.dtypes)[char_col]
    c = chars.select(*ids, F.col(char_col).alias("_p"), F.lit(0).alias("_kind"), F.lit(0).alias("_k"),
                     F.lit(None).cast(t.schema["_t"].dataType).alias("_t"), F.lit(None).cast(t.schema["_t"].dataType).alias("_any"), char_col)
    x = t.withColumn(char_col, F.col(char_col).cast(kind)).unionByName(c)
    # from the end: tokens that end after a char come before it, those that end at it after it; of equal ends the first token last
    w = Window.partitionBy(*ids).orderBy(F.desc("_p"), F.asc("_kind"), F.desc("_k"))
    x = x.withColumn("_near", F.last("_t", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.withColumn("_last", F.max("_any").over(Window.partitionBy(*ids))).where((F.col("_kind") == 0) & F.col("_last").isNotNull())
    c = F.col(char_col)
    chosen = F.when(F.col("_near.start") <= c, F.col("_near")).otherwise(F.col("_last"))
    return x.select(*ids, char_col, chosen["token_index"].alias("token_index"), (chosen["start"] == c).alias("aligned"))


def spans_to_tokens_long(offsets: DataFrame, spans: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """C4 over long offsets ``(ids, token_index, start, end)`` and mask spans ``(ids, start, end)``: the tokens that overlap a
    span, each once (the interval form of ``mask_to_tokens``; spans may overlap, nest or be empty).

    Spans (by their start) and tokens (by their end) are put together and sorted once per document; a token overlaps a span
    if, of the spans that start before its end, the farthest end lies beyond its start: a running maximum, so the work is
    linear in tokens and spans after the sort.
    """
    ids = list(id_cols)
    t = offsets.where(F.col("end") > F.col("start")).select(
        *ids, F.col("end").alias("_p"), F.lit(0).alias("_kind"), "token_index", "start", F.lit(None).cast("int").alias("_e"))
    s = spans.where(F.col("end") > F.col("start")).select(
        *ids, F.col("start").alias("_p"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("token_index"),
        F.lit(None).cast("int").alias("start"), F.col("end").cast("int").alias("_e"))
    w = Window.partitionBy(*ids).orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = t.unionByName(s).withColumn("_reach", F.max("_e").over(w))
    return x.where((F.col("_kind") == 0) & (F.col("_reach") > F.col("start"))).select(*ids, "token_index")


def char_to_token(starts, ends, char_index) -> tuple[Column, Column]:
    """C3 in array form over parallel ``starts``/``ends``: ``(token_index, aligned)``.

    First token with ``start <= c < end``, else the last token. Inputs should be
    columns (not expressions) since lambdas re-evaluate what they reference; the
    NULL guards also keep the optimizer from inlining producers into the lambda.
    """
    s, e, c = col_(starts), col_(ends), col_(char_index)
    idx = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (F.get(s, i) <= c) & (c < F.get(e, i)))
    tok = F.coalesce(F.get(idx, 0), F.size(s) - 1)
    ok = s.isNotNull() & e.isNotNull() & c.isNotNull() & (F.size(s) > 0)
    return F.when(ok, tok), F.when(ok, F.get(s, tok) == c)


def mask_to_tokens(starts, ends, char_mask, shift: bool = False) -> Column:
    """C4: indices of tokens overlapping any masked character (``shift`` = E7's index - 1, dropping -1)."""
    s, e, m = col_(starts), col_(ends), col_(char_mask)
    idx = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                   lambda i: F.exists(F.slice(m, F.get(s, i) + 1, F.get(e, i) - F.get(s, i)), lambda v: v > 0))
    ok = s.isNotNull() & e.isNotNull() & m.isNotNull() & (F.size(s) > 0)
    idx = F.when(ok, idx).otherwise(F.array().cast("array<int>"))
    return shift_indices(idx) if shift else idx


def shift_indices(idx) -> Column:
    """E7 for important-token indices: index - 1 (next-token loss), dropping the first token."""
    return F.filter(F.transform(col_(idx), lambda i: i - 1), lambda i: i >= 0)
