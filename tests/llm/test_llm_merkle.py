"""The Merkle manifest against a plain reckoning in Python."""

import random
import zlib
from hashlib import sha256

import pytest

from tokenloom.llm.merkle import manifest, rank_index, ranked, tampered_ids, verify

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return sha256(s.encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """The root, and each node's steps (before, after) up to it."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 16 * 16: k // 16 * 16 + 16]
            paths[i].append(("".join(run[:k % 16]), "".join(run[k % 16 + 1:])))
            at[i] = k // 16
        level = [sha("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
    return level[0], paths


def slow(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> result tuples."""
    def leaf(r, change=False):
        r = (*r[:4], r[4].translate(LOWER) if change and r[4] is not None else r[4])
        return sha("".join(map(field, r)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], []
    for s in sources:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in mine])
        subs.append(root)
        inner.append((mine, paths))
    root, above = tree(subs)
    out = []
    for (mine, paths), sub, up in zip(inner, subs, above, strict=True):
        for k, (r, path) in enumerate(zip(mine, paths, strict=True)):
            path = path + up
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            x = leaf(r, change)
            for before, after in path:
                x = sha(before + x + after)
            out.append((r[0], k, leaf(r), sub, root, sha("".join(a + b for a, b in path)), x, x == root))
    return sorted(map(repr, out))


COLS = ("doc_id", "position", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def fast(df):
    got = verify(manifest(df, tampered=tampered_ids())).select(*COLS)
    return sorted(repr(tuple(r)) for r in got.collect())


def test_awkward_rows(spark, awkward, nothing):
    df = awkward.selectExpr("*", "CASE WHEN doc_id % 2 = 0 THEN doc_id END AS n_chars", "'x' AS p", "'y' AS g", "'z' AS leaf")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert fast(df) == slow(rows)
    assert manifest(nothing.selectExpr("*", "1L AS n_chars")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_runs_that_end_early(spark, n):
    rows = [(i * 3, "s", "en", i, f"Text {i}") for i in range(n)]
    assert fast(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_sparse_ids_many_sources_and_ties(spark):
    """Ids over the whole range of a long, more than 16 sources, and a third of the rows under one id, under none, or alike."""
    rnd = random.Random(5)
    rows = [(rnd.randrange(-2 ** 63, 2 ** 63), f"s{rnd.randrange(20)}" if i % 3 else "s", "en", i, f"A{i}") for i in range(900)]
    rows += [(7, "s", "en", i % 40, "Same") for i in range(300)] + [(None, "s", None, 1, f"B{i % 9}") for i in range(300)]
    rows += [(None, None, None, None, None)] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert fast(df) == slow(rows)


def test_directory_of_many_nodes(spark):
    """Ranks through several levels of the directory: sparse ids give one word each."""
    rows = spark.range(0, 5000, numPartitions=4).selectExpr("'a' AS g", "(id * 7919) % 5000 * 1000003 - 2000000000 AS id")
    index, repeats = rank_index(rows, ["g"], "id")
    assert not repeats and index.count() == 5000
    got = ranked(rows, index, ["g"], "id", "r", "n").collect()
    assert sorted(r.r for r in got) == list(range(5000))
    assert all(r.id == r.r * 1000003 - 2000000000 and r.n == 1 for r in got)
