"""Tokenisation surface.

Built-in tokenizer: whitespace tokens with md5-derived INT ids (JVM-side, no
Python). Any other tokenizer plugs in as a callable ``list[str] -> list[list[int]]``
run by an Arrow-batched pandas UDF. Token text is kept beside the ids, so
decoding is a projection (or a join to a vocabulary table).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.text import WS_CLASS, col_, token_id, ws_tokens


def tokenize(df: DataFrame, text: str = "text", *, ids_col: str = "input_ids", tokens_col: str | None = "tokens",
             fn: Callable[[list[str]], list[list[int]]] | None = None,
             attention_col: str | None = None) -> DataFrame:
    """Add ``input_ids`` (array<int>) and optionally the token strings and an all-ones attention mask."""
    if fn is None:
        toks = ws_tokens(text)
        out = df.withColumn("_toks", toks).withColumn(ids_col, F.transform("_toks", token_id))
        out = out.withColumnRenamed("_toks", tokens_col) if tokens_col else out.drop("_toks")
    else:
        out = df.withColumn(ids_col, _callable_udf(fn)(col_(text)))
    if attention_col:
        out = out.withColumn(attention_col, F.transform(ids_col, lambda _: F.lit(1)))
    return out


PIECE = 1 << 20  # bytes of text that become Python strings, and go through one call of a tokenizer, together


def pieces_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive stretches of rows of ``limit`` bytes at most in all, or of one row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield first, end
        first = end


def _ids_of(texts: pa.Array, fn) -> pa.Array:
    """The ids of each text as ``list<int32>``; NULL counts as empty."""
    ids = pa.array(fn(["" if t is None else t for t in texts.to_pylist()]), pa.list_(pa.int32()))
    if len(ids) != len(texts):
        raise ValueError(f"the tokenizer gave {len(ids)} lists for {len(texts)} texts")
    return ids


def text_bytes(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, NULL: 0."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _callable_udf(fn):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _tok(s: pa.Array) -> pa.Array:
        done = [_ids_of(s.slice(a, b - a), fn) for a, b in pieces_of(text_bytes(s), PIECE)]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return _tok


def ids_of_pieces(fn):
    """A column function: ``array<string>`` to the ids of each element. The elements of a row go through the same call of ``fn``,
    together with those of other rows up to ``PIECE`` bytes: of a batch only so many are Python strings and lists at a time."""
    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def _pieces(s: pa.Array) -> pa.Array:
        texts = s.flatten()
        counts = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(text_bytes(texts))])
        done = [_ids_of(texts.slice(at[a], at[b] - at[a]), fn) for a, b in pieces_of(np.diff(upto[at]), PIECE)]
        ids = pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids)

    return _pieces


# Built-in tokens as a Python pattern (same class as WS_CLASS) for the offsets helper.
_TOKEN_RE = re.compile(r"[^ \t\n\x0b\f\r]+")
OFFSETS_TYPE = T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())),
                             T.StructField("ends", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(OFFSETS_TYPE)
def token_spans(texts: pd.Series) -> pd.DataFrame:
    """Half-open code-point offsets of the built-in tokens: ``struct<starts, ends>``.

    A small Arrow-batched helper (regex scan per text, numpy out): it keeps every
    document in its own row, so offsets need no shuffle, unlike a window over
    exploded pieces.
    """
    starts, ends = [], []
    for t in texts.tolist():
        sp = np.array([m.span() for m in _TOKEN_RE.finditer(t or "")], dtype=np.int32).reshape(-1, 2)
        starts.append(sp[:, 0])
        ends.append(sp[:, 1])
    return pd.DataFrame({"starts": starts, "ends": ends})


def spans_by(fn: Callable[[list[str]], list[list[tuple[int, int]]]]):
    """As ``token_spans`` for any tokenizer: ``fn`` gives the (start, end) of every token of each text."""
    @F.pandas_udf(OFFSETS_TYPE)
    def _spans(texts: pd.Series) -> pd.DataFrame:
        found = [np.array(list(x), dtype=np.int32).reshape(-1, 2) for x in fn([t or "" for t in texts.tolist()])]
        return pd.DataFrame({"starts": [x[:, 0] for x in found], "ends": [x[:, 1] for x in found]})

    return _spans


def decode(tokens_col: str = "tokens", sep: str = " "):
    """Decode built-in tokens back to text (a projection)."""
    return F.array_join(F.col(tokens_col), sep)


def token_offsets(df: DataFrame, id_cols: Sequence[str], text: str = "text") -> DataFrame:
    """Long form (for range joins against other long tables; ``token_spans`` is the in-row form) ``id_cols..., token_index, token, start, end`` with half-open char offsets.

    The text is cut into alternating whitespace / non-whitespace runs; a window
    per document (bounded by the document's length) turns run lengths into
    offsets. Run ``p`` is a token exactly when it is non-whitespace, and its
    token index is ``p div 2`` because runs alternate.
    """
    ids = list(id_cols)
    pieces = F.regexp_extract_all(col_(text), F.lit(f"{WS_CLASS}+|[^{WS_CLASS[1:-1]}]+"), 0)
    x = df.select(*ids, F.posexplode(pieces).alias("_p", "token"))
    from pyspark.sql import Window
    w = Window.partitionBy(*ids).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("end", F.sum(F.length("token")).over(w).cast("int"))
    x = x.withColumn("start", (F.col("end") - F.length("token")).cast("int"))
    return (x.where(~F.col("token").rlike(f"^{WS_CLASS}"))
            .select(*ids, F.floor(F.col("_p") / 2).cast("int").alias("token_index"), "token", "start", "end"))
