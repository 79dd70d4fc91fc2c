"""Loss-mask queries over ``documents``."""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.text import WS_CLASS, ws_tokens
from tokenloom.operators.masks import (
    char_to_token,
    char_to_token_long,
    drop_unmaskable,
    mask_to_tokens,
    shift_indices,
    with_token_budget,
    segment_token_mask,
    span_segments,
    spans_to_tokens_long,
    zero_bad_words,
)
from tokenloom.operators.tokenize import PIECE, pieces_of, text_bytes, token_offsets, token_spans
from tokenloom.plans.chat import strip_sql
from tokenloom.plans.registry import query, table
from tokenloom.plans.training import TOKENS_SQL

TOXIC, SAFE = 0.8, 0.3
# The bad-word list of the masking queries (frequent function words of the four languages).
BAD_WORDS = ["the", "and", "of", "de", "la", "le", "und", "die", "der", "el", "y"]
SEED = 42


_LINE_RE = re.compile(r"[^\n]+")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _line_spans(texts: list[str | None]) -> pa.Array:
    """The spans of each text."""
    upto, starts, ends, scores = array("i", [0]), array("i"), array("i"), array("d")
    for t in texts:
        for m in _LINE_RE.finditer(t or ""):
            starts.append(m.start())
            ends.append(m.end())
            scores.append((int.from_bytes(hashlib.md5(m.group().encode()).digest()[:4]) >> 4) / float(1 << 28))
        upto.append(len(starts))
    spans = pa.StructArray.from_arrays([pa.array(np.asarray(c)) for c in (starts, ends, scores)], fields=list(_SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.asarray(upto)), spans)


def scored_line_spans(docs: DataFrame) -> DataFrame:
    """Stand-in for an outside span classifier: adds ``spans`` = the non-empty lines of each
    text as ``(start, end, score)``, score = first 28 bits of md5(line) / 2^28.

    ``mapInArrow``: per row, no shuffle (a window over exploded lines would move every document through the network),
    and an opaque plan node, so later filters on the spans are not pushed below it and the classifier runs once. The rows of
    a batch are classified, and leave, ``PIECE`` bytes of text at a time.
    """
    schema = T.StructType(docs.schema.fields + [T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType())])))])
    names, at = schema.fieldNames(), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, b in pieces_of(text_bytes(batch.column(at)), PIECE):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, _line_spans(rows.column(at).to_pylist())], names)

    return docs.mapInArrow(run, schema)


@query("span_segments", f"""
WITH p AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), o AS (
  SELECT doc_id, text, line, k,
         (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::BIGINT AS e
  FROM p
), s AS (
  SELECT doc_id, text, k, e - length(line) AS st, e,
         ('0x' || substr(md5(line), 1, 7))::BIGINT / 268435456.0 AS score FROM o WHERE length(line) > 0
), seg AS (
  SELECT doc_id, k, least(coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0), st) AS lo, e AS hi,
         CASE WHEN score > {TOXIC} THEN 3 WHEN score > {SAFE} THEN 2 ELSE 1 END AS label, text FROM s
), tail AS (
  SELECT doc_id, max(k) + 1 AS k, max(e) AS lo, length(any_value(text)) AS hi, 1 AS label, any_value(text) AS text
  FROM s GROUP BY doc_id HAVING max(e) < length(any_value(text))
), allseg AS (
  SELECT doc_id, k, label, len({TOKENS_SQL.format(t='substr(text, lo + 1, hi - lo)')}) AS nt
  FROM (SELECT * FROM seg UNION ALL SELECT * FROM tail)
)
SELECT doc_id, count(*)::INTEGER AS n_segments, sum(nt)::INTEGER AS n_tokens, sum(nt * label)::INTEGER AS mask_sum,
       md5(string_agg(repeat(label::VARCHAR || ',', nt::BIGINT), '' ORDER BY k)) AS mask_md5
FROM allseg GROUP BY doc_id
""")
def q_span_segments(spark, sf_dir):
    """E6 + H10 + H11 + B8: line spans scored, segmented, tokenised into a per-token severity mask."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = scored_line_spans(d)
    x = x.withColumn("segments", span_segments("text", "spans", TOXIC, SAFE))
    x = drop_unmaskable(x)
    ids, mask = segment_token_mask("segments")
    x = x.select("doc_id", F.size("segments").alias("n_segments"), ids.alias("input_ids"), mask.alias("loss_mask"))
    return x.select("doc_id", "n_segments", F.size("input_ids").alias("n_tokens"),
                    F.aggregate("loss_mask", F.lit(0), lambda a, v: a + v).alias("mask_sum"),
                    F.md5(F.array_join(F.transform("loss_mask", lambda v: F.concat(v.cast("string"), F.lit(","))), ""))
                    .alias("mask_md5"))


def _docs(spark, sf_dir) -> DataFrame:
    """All documents. A NULL text counts as empty; that is settled on the results, as a text the optimizer knows to be
    non-NULL would let it inline the token arrays into the lambdas."""
    return table(spark, sf_dir, "documents")


_BUDGET_SQL = f"""
WITH t AS (SELECT doc_id, {TOKENS_SQL.format(t="coalesce(text, '')")} AS toks FROM documents),
u AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('{SEED}:' || doc_id::VARCHAR || ':' || pos::VARCHAR)) AS rk
      FROM u),
m AS (SELECT doc_id, n, pos, (rk <= floor(n * 0.25))::INTEGER AS sel,
             CASE WHEN rk <= floor(n * 0.25) AND lower({strip_sql('tok')}) IN ({", ".join(repr(w) for w in BAD_WORDS)})
                  THEN 0 WHEN rk <= floor(n * 0.25) THEN 1 ELSE 0 END AS kept FROM r)
"""


@query("token_budget_mask", _BUDGET_SQL + """
SELECT doc_id, count(pos)::INTEGER AS n_tokens, coalesce(sum(sel), 0)::INTEGER AS n_selected,
       md5(coalesce(string_agg(sel::VARCHAR, '' ORDER BY pos), '')) AS mask_md5
FROM t LEFT JOIN m USING (doc_id) GROUP BY doc_id
""")
def q_token_budget_mask(spark, sf_dir):
    """exactly int(n * 0.25) seeded positions per document."""
    d = _docs(spark, sf_dir).select("doc_id", ws_tokens("text").alias("tokens"))
    x = with_token_budget(d.withColumn("n", F.size("tokens")), "n", 0.25, SEED, "doc_id")
    return x.select("doc_id", F.size("mask").alias("n_tokens"),
                    F.aggregate("mask", F.lit(0), lambda a, v: a + v).alias("n_selected"),
                    F.md5(F.array_join(F.transform("mask", lambda v: v.cast("string")), "")).alias("mask_md5"))


@query("badword_mask", _BUDGET_SQL + """
SELECT doc_id, coalesce(sum(sel), 0)::INTEGER AS n_selected, coalesce(sum(kept), 0)::INTEGER AS n_kept,
       md5(coalesce(string_agg(kept::VARCHAR, '' ORDER BY pos), '')) AS mask_md5
FROM t LEFT JOIN m USING (doc_id) GROUP BY doc_id
""")
def q_badword_mask(spark, sf_dir):
    """F4 + H12: seeded token budget, then bad words zeroed."""
    d = _docs(spark, sf_dir).select("doc_id", ws_tokens("text").alias("tokens"))
    x = with_token_budget(d.withColumn("n", F.size("tokens")), "n", 0.25, SEED, "doc_id")
    x = x.withColumn("kept", zero_bad_words("mask", "tokens", BAD_WORDS))
    return x.select("doc_id", F.aggregate("mask", F.lit(0), lambda a, v: a + v).alias("n_selected"),
                    F.coalesce(F.aggregate("kept", F.lit(0), lambda a, v: a + v), F.lit(0)).alias("n_kept"),
                    F.md5(F.coalesce(F.array_join(F.transform("kept", lambda v: v.cast("string")), ""), F.lit("")))
                    .alias("mask_md5"))


_OFFSETS_SQL = r"""
WITH p AS (
  SELECT doc_id, text, unnest(regexp_extract_all(text, '[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+')) AS piece,
         generate_subscripts(regexp_extract_all(text, '[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+'), 1) - 1 AS pi
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), o AS (
  SELECT doc_id, text, piece, pi,
         sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM p
), tok AS (
  SELECT doc_id, text, piece, pi // 2 AS ti, e - length(piece) AS st, e FROM o
  WHERE NOT regexp_matches(piece, '^[ \t\n\x0B\f\r]')
)
"""


@query("char_to_token", _OFFSETS_SQL + """
, c AS (SELECT doc_id, length(coalesce(text, '')) // 2 AS ch FROM documents)
, pick AS (
  SELECT c.doc_id, c.ch,
         coalesce(min(CASE WHEN st <= c.ch AND c.ch < e THEN ti END), max(ti)) AS ti FROM c LEFT JOIN tok USING (doc_id)
  GROUP BY c.doc_id, c.ch
)
SELECT pick.doc_id, pick.ch::INTEGER AS char_index, pick.ti::INTEGER AS token_index, tok.st = pick.ch AS aligned
FROM pick LEFT JOIN tok ON pick.doc_id = tok.doc_id AND pick.ti = tok.ti
""")
def q_char_to_token(spark, sf_dir):
    """The token holding each document's middle character, and whether it starts there.

    Offsets come from the in-row tokenizer helper; no shuffle.
    """
    x = _docs(spark, sf_dir).select("doc_id", token_spans("text").alias("o"),
                                             F.coalesce(F.floor(F.length("text") / 2), F.lit(0)).cast("int").alias("char_index"))
    x = x.select("doc_id", "char_index", "o.starts", "o.ends")
    tok, aligned = char_to_token("starts", "ends", "char_index")
    return x.select("doc_id", "char_index", tok.alias("token_index"), aligned.alias("aligned"))


@query("mask_to_token", _OFFSETS_SQL + """
SELECT doc_id, count(piece)::INTEGER AS n_tokens,
       count(*) FILTER (WHERE regexp_matches(piece, '[A-Z]'))::INTEGER AS n_selected,
       md5(coalesce(string_agg(ti::VARCHAR, ',' ORDER BY ti) FILTER (WHERE regexp_matches(piece, '[A-Z]')), '')) AS sel_md5,
       md5(coalesce(string_agg((ti - 1)::VARCHAR, ',' ORDER BY ti)
                    FILTER (WHERE regexp_matches(piece, '[A-Z]') AND ti >= 1), '')) AS shifted_md5
FROM (SELECT doc_id FROM documents) LEFT JOIN tok USING (doc_id) GROUP BY doc_id
""")
def q_mask_to_token(spark, sf_dir):
    """C4 + E7: tokens overlapping a character mask (uppercase ASCII letters), and the shifted loss indices."""
    char_mask = F.transform(F.split(F.regexp_replace(F.regexp_replace("text", "[^A-Z]", "0"), "[A-Z]", "1"), ""),
                            lambda c: c.try_cast("int"))
    x = (_docs(spark, sf_dir).select("doc_id", token_spans("text").alias("o"), char_mask.alias("mask"))
         .select("doc_id", "o.starts", "o.ends", "mask"))
    x = x.select("doc_id", F.coalesce(F.size("starts"), F.lit(0)).alias("n_tokens"), mask_to_tokens("starts", "ends", "mask").alias("sel"))
    x = x.withColumn("sh", shift_indices("sel"))
    return x.select("doc_id", "n_tokens", F.size("sel").alias("n_selected"),
                    F.md5(F.array_join(F.transform("sel", lambda v: v.cast("string")), ",")).alias("sel_md5"),
                    F.md5(F.array_join(F.transform("sh", lambda v: v.cast("string")), ",")).alias("shifted_md5"))


_LINES_SQL = _OFFSETS_SQL + """
, l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k
         FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, k, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - 1 - length(line) AS st, length(line) AS n FROM l0)
"""


def _lines_long(docs: DataFrame) -> DataFrame:
    """(doc_id, k, start, end) of every line of every document."""
    x = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    x = x.select("doc_id", "k", F.length("line").alias("n"))
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return x.withColumn("start", before).withColumn("end", F.col("start") + F.col("n"))


@query("line_start_tokens", _LINES_SQL + """
, pick AS (SELECT l.doc_id, l.k, l.st AS ch, coalesce(min(CASE WHEN tok.st <= l.st AND l.st < e THEN ti END), max(ti)) AS ti
           FROM l JOIN tok ON l.doc_id = tok.doc_id GROUP BY l.doc_id, l.k, l.st)
SELECT pick.doc_id, count(*)::BIGINT AS n_lines, sum(pick.ti)::BIGINT AS token_sum, count(*) FILTER (WHERE tok.st = pick.ch)::BIGINT AS n_aligned
FROM pick JOIN tok ON pick.doc_id = tok.doc_id AND pick.ti = tok.ti GROUP BY pick.doc_id
""")
def q_line_start_tokens(spark, sf_dir):
    """C3, long form: the token at the beginning of every line, by an as-of join."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    chars = _lines_long(d).select("doc_id", F.col("start").alias("char_index"))
    x = char_to_token_long(token_offsets(d, ["doc_id"]), chars, ["doc_id"])
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("token_index").alias("token_sum"),
                                   F.count_if("aligned").alias("n_aligned"))


@query("span_tokens", _LINES_SQL + """
, h AS (SELECT DISTINCT tok.doc_id, ti FROM tok JOIN l ON tok.doc_id = l.doc_id AND l.k % 3 = 0 AND tok.st < l.st + l.n // 2 AND tok.e > l.st)
SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(ti)::BIGINT AS token_sum FROM h GROUP BY doc_id
""")
def q_span_tokens(spark, sf_dir):
    """C4, long form: tokens that overlap the first half of every third line, by an interval-overlap join."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = _lines_long(d).where("k % 3 = 0").select("doc_id", "start", (F.col("start") + F.floor(F.col("n") / 2)).cast("int").alias("end"))
    x = spans_to_tokens_long(token_offsets(d, ["doc_id"]), spans, ["doc_id"])
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("token_index").alias("token_sum"))
