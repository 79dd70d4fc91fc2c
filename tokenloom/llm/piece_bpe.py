"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model asks and cut into chunks (a run of word marks and what follows), which are independent because
no piece holds a word mark after another character; that is checked when a model is loaded. A chunk is encoded by a
score-ordered agenda of adjacent symbol pairs: the pair whose joined piece scores best, the leftmost of equals, is
merged until none is left, and symbols outside the vocabulary fall back to bytes. New chunks are first cut between characters
that no piece holds side by side, as no merge reaches over such a place. The new short stretches of a few texts
are merged together, one agenda a row of a matrix and one merge each a round; long ones have a heap. Ids are kept
in bounded tables of chunks and stretches, so frequent words are merged once. Every text's ids and decoded text are checked against the
sentencepiece library in the same Arrow batch, and a difference fails the job.

Rows are independent: no shuffle, and a lost executor costs its batches. Defined cases: null and empty texts have no ids
and decode to the empty text; texts of any length are encoded whole, a few at a time; repeated rows give equal results;
an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
BATCH_CHARS = 1 << 20  # texts encoded, and handed to the library, together
KEPT_CHUNKS = 100_000  # entries of a table before it is emptied; bounds the memory of a worker
LONG = 48  # characters of a stretch that gets a heap of its own
NONE = np.int32(2 ** 31 - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd; its product's upper bits spread pairs over slots


class Table:
    """Ids of strings, kept in one pool and found by the string's number."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.pool, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def large(self) -> bool:
        return len(self.number) >= KEPT_CHUNKS or len(self.pool) > 16 * KEPT_CHUNKS  # long strings count by their ids

    def add(self, new: list[str], ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        self.start = np.concatenate([self.start, start + len(self.pool)])
        self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, ids])

    def of(self, strings: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings in a row, and the places where each one's begin, with the end."""
        numbers = np.fromiter(map(self.number.__getitem__, strings), np.int64)
        size = self.size[numbers]
        until = np.append(0, np.cumsum(size))
        return self.pool[np.repeat(self.start[numbers] - until[:-1], size) + np.arange(until[-1])], until


class PieceModel:
    """A merge-type model: own encoding and decoding, and the library's beside it."""

    def __init__(self, path: str):
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        if any(lib.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.id = {lib.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            raise ValueError("a piece holds a word mark after another character")
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = lib.id_to_piece(i).replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.raw[lib.unk_id()] = " ⁇ ".encode()
        self.is_byte = frozenset(self.byte.values())
        self.hidden = frozenset(i for i in range(n) if lib.is_control(i))  # no text, and the start stays the start
        self.decimal = [str(i) for i in range(n)]
        self.cut = re.compile(f"{MARK}+[^{MARK}]*").findall
        self.forget()
        # symbols: pieces by id, other characters n + code point; pairs of symbols that join to a piece, by code
        self.n, self.symbols = n, n + 0x110000
        self.of_char = np.arange(n, self.symbols, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i

        def symbol(p: str) -> int | None:
            return self.id.get(p) if len(p) > 1 else int(self.of_char[ord(p)])

        pairs = sorted((symbol(p[:k]) * self.symbols + symbol(p[k:]), i) for p, i in self.id.items()
                       for k in range(1, len(p)) if symbol(p[:k]) is not None and symbol(p[k:]) is not None)
        codes, joined = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        levels, place = np.unique(-np.array([lib.get_score(int(i)) for i in joined]), return_inverse=True)
        place = place.astype(np.int32)  # equal scores have one rank
        of_rank: list[set[int]] = [set() for _ in levels]
        for i, k in zip(joined.tolist(), place.tolist()):
            of_rank[k].add(i)
        self.of_rank = np.array([min(x) if len(x) == 1 else -1 for x in of_rank], np.int32)  # -1: several pieces
        self.codes, self.code_ranks, self.joined = np.append(codes, -1), np.append(place, NONE), joined
        bits = max(4, (16 * len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.slot_ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        self.slots[self._slot(codes)], self.slot_ranks[self._slot(codes)] = codes, place
        # characters that stand side by side in some piece: between any others nothing is ever merged
        side = sorted({c for p in self.id if len(p) > 1 for c in p})
        self.side = np.zeros(0x110000, np.int32)
        self.side[[ord(c) for c in side]] = np.arange(1, len(side) + 1)
        self.beside = np.zeros((len(side) + 1, len(side) + 1), bool)
        for p in self.id:
            for x, y in zip(p, p[1:]):
                self.beside[self.side[ord(x)], self.side[ord(y)]] = True

    def merge(self, chunk: str) -> list[int]:
        """Ids of a normalised chunk by the agenda."""
        sym: list[str] = list(chunk)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            piece = sym[i] + sym[j]
            s = self.score.get(piece)
            if s is not None:
                heapq.heappush(agenda, (-s, i, j, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if right[i] != j or sym[i] + sym[j] != piece or not sym[i] or not sym[j]:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = piece, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                offer(i, k)
            if left[i] >= 0:
                offer(left[i], i)
        ids: list[int] = []
        for s in filter(None, sym):
            one = self.id.get(s)
            ids.extend([one] if one is not None else [self.byte[b] for b in s.encode()])
        return ids

    def _code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * self.symbols + b

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return code.astype(np.uint64) * SPREAD >> self.shift

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank, by score, of the piece that symbols join to; NONE where they don't join."""
        code = self._code(a, b)
        at = self._slot(code)
        there = self.slots[at]
        out = np.where(there == code, self.slot_ranks[at], NONE)
        other = (there != code) & (there >= 0)  # a slot that another pair holds
        if other.any():
            rest = code[other]
            at = np.searchsorted(self.codes[:-1], rest)
            out[other] = np.where(self.codes[at] == rest, self.code_ranks[at], NONE)
        return out

    def _merged(self, sym: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their symbols) as rows of a matrix of stretches of one length come to an end.

        Every round merges the best pair of each row, so all rows still open are equally long.
        """
        rows, rank = np.arange(len(sym)), self._ranks(sym[:, :-1], sym[:, 1:])
        while sym.shape[1] > 1:
            j = rank.argmin(axis=1)  # the leftmost of equals
            best = rank[np.arange(len(j)), j]
            open_ = best < NONE
            if not open_.all():
                yield rows[~open_], sym[~open_]
                rows, sym, rank, best, j = rows[open_], sym[open_], rank[open_], best[open_], j[open_]
                if not len(rows):
                    return
            r, width = np.arange(len(rows)), sym.shape[1] - 1
            piece = self.of_rank[best]
            if len(several := np.flatnonzero(piece < 0)):
                a, b = sym[several, j[several]], sym[several, j[several] + 1]
                piece[several] = self.joined[np.searchsorted(self.codes[:-1], self._code(a, b))]
            sym[r, j] = piece
            stay = np.ones(sym.shape, bool)
            stay[r, j + 1] = False
            sym, rank = sym[stay].reshape(len(r), width), rank[stay[:, 1:]].reshape(len(r), width - 1)
            at, on = np.concatenate([j - 1, j]), np.concatenate([r, r])  # the pairs on either side of the new symbol
            has = (at >= 0) & (at < width - 1)
            at, on = at[has], on[has]
            rank[on, at] = self._ranks(sym[on, at], sym[on, at + 1])
        yield rows, sym

    def _merge_rows(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): those of stretch i are ids[start[i]:start[i] + size[i]]."""
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        start, size, out, end = np.zeros_like(length), np.zeros_like(length), [np.empty(0, np.int32)], 0
        for n in np.unique(length).tolist():
            same = np.flatnonzero(length == n)
            if n > LONG:
                groups = ((same[k:k + 1], np.array([self.merge(parts[i])])) for k, i in enumerate(same.tolist()))
            else:
                points = np.frombuffer("".join([parts[i] for i in same.tolist()]).encode("utf-32-le"), np.uint32)
                groups = ((same[rows], sym) for rows, sym in self._merged(self.of_char[points.reshape(-1, n)]))
            for at, sym in groups:
                odd = (sym >= self.n).any(axis=1)  # symbols outside the vocabulary
                for i, ids in [(at[~odd], sym[~odd]), *((at[k:k + 1], self._bytes_of(sym[k])) for k in np.flatnonzero(odd))]:
                    start[i], size[i] = end + np.arange(len(i)) * ids.shape[1], ids.shape[1]
                    out.append(ids.astype(np.int32).ravel())
                    end += ids.size
        return np.concatenate(out), start, size

    def merge_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): those of chunk i are ids[start[i]:start[i] + size[i]].

        A chunk is first cut between characters that no piece holds side by side; the stretches are merged.
        """
        text = "".join(chunks)
        side = self.side[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(text) + 1, bool)
        cut[1:-1] = ~self.beside[side[:-1], side[1:]]
        begin = np.cumsum([0, *map(len, chunks)])
        cut[begin] = True
        ends = np.flatnonzero(cut)
        parts = [text[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        if new := list(set(parts).difference(self.parts.number)):
            self.parts.add(new, *self._merge_rows(new))
        ids, until = self.parts.of(parts)
        start = until[np.searchsorted(ends, begin)]
        return ids, start[:-1], np.diff(start)

    def _bytes_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.array([[i for s in symbols.tolist() for i in self._fallback(s)]])

    def _fallback(self, symbol: int) -> list[int]:
        return [symbol] if symbol < self.n else [self.byte[b] for b in chr(symbol - self.n).encode()]

    def forget(self) -> None:
        """Empties the tables of chunks (without their first mark) and of stretches."""
        self.words, self.parts = Table(), Table()

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each whole text."""
        if self.words.large():
            self.words = Table()
        if self.parts.large():
            self.parts = Table()
        cut = []
        for t in texts:
            words = self.lib.normalize(t).split(MARK) if t else [""]
            if words[0]:
                raise ValueError("models without a dummy prefix are not supported")
            del words[0]
            if "" in words:  # runs of marks belong to what follows
                words = [c[1:] for c in self.cut(MARK + MARK.join(words))]
            cut.append(words)
        if new := list(set(chain.from_iterable(cut)).difference(self.words.number)):
            self.words.add(new, *self.merge_many([MARK + w for w in new]))
        ids, until = self.words.of(chain.from_iterable(cut))
        ids, at = ids.tolist(), until[np.cumsum([0, *map(len, cut)])].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: marks are spaces, the leading mark goes, bytes that form no character are U+FFFD."""
        raw = self.raw
        begin = next((k for k, i in enumerate(ids) if i not in self.hidden), len(ids))
        if begin == len(ids):
            return ""
        first = raw[ids[begin]]
        if first[:1] == b" " and ids[begin] != self.lib.unk_id() and ids[begin] not in self.is_byte:
            first = first[1:]
        rest = ids[begin + 1:]
        if self.hidden.isdisjoint(rest):
            try:
                return (first + b"".join(map(raw.__getitem__, rest))).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""  # byte runs end at any other piece, and each stray byte is one U+FFFD
        for k, i in enumerate([*ids[begin:], None]):
            if i in self.is_byte:
                run += raw[i]
                continue
            while run:
                n = next((n for n in (1, 2, 3, 4) if len(_whole(run[:n])) == 1), 0)
                out.append(_whole(run[:n]) if n else "�")
                run = run[n or 1:]
            if i is not None:
                out.append((first if k == 0 else raw[i]).decode())
        return "".join(out)


def _whole(b: bytes) -> str:
    try:
        return b.decode()
    except UnicodeDecodeError:
        return ""


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= BATCH_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _same(what: str, texts: list[str], own: list, theirs: list) -> None:
    for t, a, b in zip(texts, own, theirs, strict=True):
        if a != b:
            raise RuntimeError(f"{what} differ from the sentencepiece library's for the text of {len(t)} characters with sha256 "
                               f"{_sha(t)}, which begins {t[:80]!r}")


def _checked(m: PieceModel, texts: list[str]) -> Iterator[tuple[list[int], str]]:
    """(ids, decoded text) of each text, equal to the library's; an error names the text that isn't."""
    for part in _groups(texts):
        own = m.encode_many(part)
        _same("ids", part, own, m.lib.encode(part, num_threads=1))
        back = [m.decode(ids) for ids in own]
        _same("decoded texts", part, back, m.lib.decode(own, num_threads=1))
        yield from zip(own, back)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def encode(docs: DataFrame, model: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array column ``ids``; a column of that name is replaced."""
    @F.pandas_udf("array<int>")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series([x[0] for x in _checked(load(model), [t or "" for t in s])], dtype="object")
    return docs.withColumn(ids, udf(text))


def decode(docs: DataFrame, model: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the text of the array column ``ids``; null ids give the empty text."""
    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        m = load(model)
        return pd.Series([m.decode([int(i) for i in x]) if x is not None else "" for x in s], dtype="object")
    return docs.withColumn(text, udf(ids))


def digests(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; the ids don't leave the batch."""
    @F.pandas_udf("n long, i string, d string")
    def udf(s: pd.Series) -> pd.DataFrame:
        m = load(model)
        texts = list(dict.fromkeys(t or "" for t in s))  # equal texts of a batch are encoded once
        rows = {t: (len(ids), _sha(",".join(map(m.decimal.__getitem__, ids))), _sha(back))
                for t, (ids, back) in zip(texts, _checked(m, texts))}
        return pd.DataFrame([rows[t or ""] for t in s], columns=["n", "i", "d"])
    got = docs.select(F.col(doc_id), udf(text).alias("x"))
    return got.select(doc_id, F.col("x.n").alias("n_tokens"), F.col("x.i").alias("ids_sha256"),
                      F.col("x.d").alias("decoded_sha256"))
