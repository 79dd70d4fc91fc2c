"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its words (hashed into ``WORDS`` counts) and their shapes and pairs of shapes (letters, capitals and digits
each written once, other signs kept; hashed into ``TERMS`` counts, beside four repetition measures). Words and shapes
have a latent space each; a document's vector is the two unit vectors side by side, so plain texts, alike in shape, are told
apart by their vocabulary. Labelled documents (at most ``sample`` of those that are
there, with the smallest id hashes: the documented bound of the fit) give term weights and the leading directions; their vectors and
labels are the voters, broadcast once (``sample`` x ``DIMS`` numbers). Every document's cosines with all
voters are computed as blocked matrix products, and the labels of the ``k`` nearest vote with a weight that
rises with similarity. Scoring is row by row: no shuffle, and a lost executor costs its batches.

Defined cases: null and empty texts score 0; without any labelled row every other text scores 0.5; ids with
several labels take their mean; null labels don't count; labels of absent documents are ignored and take no place in the
sample; repeated rows score alike; of voters equally near at the last place any may vote; an empty
table gives an empty one. Texts of any length are read whole, a megabyte at a time. Other columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS, EXTRA, WORDS, DIMS = 1024, 4, 1024, 48
SHAPES = TERMS + EXTRA  # where the counts of words begin
WORD_SHARE = 0.3  # of the vector's squared length
SAMPLE, NEIGHBOURS, POWER = 4096, 31, 8
BLOCK = 256
PIECE = 1 << 20


def _shape_table() -> bytes:
    t = bytearray(range(256))
    for i in range(256):
        c = chr(i)
        t[i] = ord("a") if i >= 128 or c.islower() else ord("A") if c.isupper() else ord("9") if c.isdigit() else i
    return bytes(t)


SHAPE = _shape_table()


def _pieces(b: bytes) -> Iterator[bytes]:
    """The text in stretches of about a megabyte, cut at blanks where there are any."""
    at = 0
    while at < len(b):
        end = at + PIECE
        if end < len(b):
            end = max(b.rfind(b" ", at, end), b.rfind(b"\n", at, end)) + 1 or end
            end = end if end > at else at + PIECE
        yield b[at:end]
        at = end


def features(text: str | None) -> np.ndarray:
    v = np.zeros(SHAPES + WORDS, np.float32)
    total, vocabulary = 0, Counter()
    for b in _pieces(text.encode() if text else b""):
        s = b.translate(SHAPE)
        for c in (b"a", b"A", b"9"):
            while c * 2 in s:
                s = s.replace(c * 4, c).replace(c * 2, c)
        words, shapes = b.lower().split(), s.split()
        if not words:
            continue
        total += len(words)
        count = Counter(shapes)
        count.update(map(b" ".join, zip(shapes, shapes[1:])))
        for term, n in count.items():
            v[zlib.crc32(term) % TERMS] += n
        vocabulary.update(words)
        v[TERMS] += sum(map(eq, words, words[1:]))
        v[TERMS + 1] += sum(map(eq, words, words[2:]))
        three = list(zip(words, words[1:], words[2:]))
        v[TERMS + 2] += len(three) - len(set(three))
        if len(vocabulary) > MOST_WORDS:
            _count(v, vocabulary)
    _count(v, vocabulary)
    if total:
        v = np.sqrt(v / total)
        v[TERMS:SHAPES] *= 2
        v[SHAPES - 1] = 0.2
    return v


MOST_WORDS = 1 << 16  # distinct words held at a time


def _count(v: np.ndarray, vocabulary: Counter) -> None:
    if vocabulary:
        at = np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary)) % WORDS + SHAPES
        v[SHAPES:] += np.bincount(at - SHAPES, np.fromiter(vocabulary.values(), float, len(vocabulary)), WORDS)
        vocabulary.clear()


class Voters:
    """Term weights and directions of words and shapes, and the voters' unit vectors with their labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.spaces = []
        for part, share, plain in ((slice(0, SHAPES), 1 - WORD_SHARE, slice(TERMS, SHAPES)), (slice(SHAPES, None), WORD_SHARE, None)):
            t = x[:, part]
            weight = (np.log((1 + len(t)) / (1 + (t > 0).sum(axis=0))) + 1).astype(np.float32)
            if plain is not None:
                weight[plain] = 1
            a = self._unit(t * weight)
            _, vec = np.linalg.eigh((a.T @ a).astype(np.float64))
            self.spaces.append((part, weight, np.ascontiguousarray(vec[:, ::-1][:, :DIMS]).astype(np.float32), share ** 0.5))
        self.z, self.y = self.embed(x), labels.astype(np.float64)

    @staticmethod
    def _unit(a: np.ndarray) -> np.ndarray:
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)

    def embed(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in both spaces, side by side."""
        return np.concatenate([self._unit(self._unit(x[:, part] * weight) @ axes) * root
                               for part, weight, axes, root in self.spaces], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        cos = self.embed(x) @ self.z.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1).astype(np.float64), 0) ** POWER + 1e-12
        return np.clip((w * self.y[near]).sum(axis=1) / w.sum(axis=1), 0, 1)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE) -> Voters | None:
    """Voters from at most ``sample`` labelled, not held-out documents; None if there are none."""
    @F.pandas_udf("binary")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in s])

    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).dropna()
    known = known.filter(~held_out("id")).join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi")
    known = known.groupBy("id").agg(F.avg("y").alias("y"))
    known = known.withColumn("o", F.xxhash64("id")).orderBy("o", "id").limit(sample)  # the fit's bound
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).filter("t IS NOT NULL")
    rows = rows.join(F.broadcast(known), "id").select("id", "o", "y", udf("t").alias("x"))
    rows = rows.groupBy("o", "id").agg(F.min(F.struct("x", "y")).alias("m"))  # one row an id, also if ids repeat
    got = sorted((r.o, r.id, bytes(r.m.x), r.m.y) for r in rows.collect())
    if not got:
        return None
    x = np.frombuffer(b"".join(r[2] for r in got), np.float32).reshape(len(got), -1)
    return Voters(x, np.array([r[3] for r in got]))


def score(docs: DataFrame, voters: Voters | None, *, text: str = "text") -> Column:
    """The column of scores of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("double")
    def udf(s: pd.Series) -> pd.Series:
        model, out = shared.value, np.zeros(len(s))
        for at in range(0, len(s), BLOCK):
            x = np.stack([features(t) for t in s[at:at + BLOCK]])
            full = np.flatnonzero(x[:, SHAPES - 1])  # texts with words
            out[at + full] = 0.5 if model is None else model.scores(x[full]) if len(full) else 0
        return pd.Series(out)
    return udf(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    voters = fit(docs, labels, doc_id=doc_id, text=text, label=label)
    out = docs.select(F.col(doc_id).alias(doc_id), held_out(doc_id).alias("held_out"),
                      score(docs, voters, text=text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
              threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    voters = fit(docs, labels, doc_id=doc_id, text=text, label=label)
    return docs.filter(score(docs, voters, text=text) >= threshold)
