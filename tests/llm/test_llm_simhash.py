import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenloom.llm.simhash_bk import (
    Forest, block_masks, connected_components, keep_one, link_groups, links, merge_labels, simhash, simhash_groups)


def slow_simhash(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(sh))


@pytest.mark.parametrize("t", [None, "", " \t", "One", "Two words", "a b c", "É a\u00a0b c d\x1fe f", "x y z " * 40_000])
def test_fingerprint(t):
    assert simhash(t) & (1 << 64) - 1 == slow_simhash(t)


def test_two_blocks_always_agree():
    masks = [m & (1 << 64) - 1 for m in block_masks(3)]
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(m & x == 0 for m in masks)


def near(prints):
    d = np.bitwise_count(prints[:, None] ^ prints[None, :])
    return d


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 15, dtype=np.uint64)) for b in base]))
    group = np.sort(rng.integers(0, 3, len(prints)))
    f = Forest(prints, np.arange(len(prints)), group)
    u, v = f.search(np.arange(len(prints)), np.array([f.root[g] for g in group.tolist()]), 3)
    want = {(i, j) for i, j in zip(*np.nonzero(near(prints) <= 3)) if i != j and group[i] == group[j]}
    assert set(zip(u.tolist(), v.tolist())) == want


def test_link_groups_empty_tree():
    p = np.array([1, 2], np.uint64)
    assert link_groups(p, np.array([0, 1]), np.array([True, False]), np.array([False, True]), 3).tolist() == [0, 1]


def brute_classes(prints):
    label = np.arange(len(prints))
    u, v = np.nonzero(near(prints) <= 3)
    return merge_labels(label, u, v)


def test_links_with_small_slices(spark):
    """A dense cluster split over several trees, and chains, join up as by brute force."""
    rng = np.random.default_rng(3)
    flips = np.array([sum(1 << int(b) for b in rng.choice(12, 3)) & (1 << 64) - 1 for _ in range(150)], np.uint64)
    prints = np.unique(np.concatenate([flips, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in connected_components(links(df, 3, tree_rows=16)).collect()}
    want = brute_classes(prints)
    signed = prints.view(np.int64).tolist()
    mine = {}
    for i, p in enumerate(signed):
        mine.setdefault(roots.get(p, p), set()).add(i)
    theirs = {}
    for i, c in enumerate(want.tolist()):
        theirs.setdefault(c, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def classes(spark, prints, tree_rows):
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in connected_components(links(df, 3, tree_rows=tree_rows)).collect()}
    mine = {}
    for i, p in enumerate(prints.view(np.int64).tolist()):
        mine.setdefault(roots.get(p, p), set()).add(i)
    return sorted(map(sorted, mine.values()))


def test_dense_low_bits(spark):
    """Thousands of prints that agree in two and more blocks are split by the bits that differ."""
    rng = np.random.default_rng(4)
    low = rng.choice(1 << 22, 3000, replace=False).astype(np.uint64) << np.uint64(2)
    prints = np.unique(low | np.uint64(1) << np.uint64(63))
    theirs = {}
    for i, c in enumerate(brute_classes(prints).tolist()):
        theirs.setdefault(c, set()).add(i)
    assert 1 < len(theirs) < len(prints)
    assert classes(spark, prints, 64) == sorted(map(sorted, theirs.values()))


def test_masks_within_bits():
    """The masks of some bits hold all others; three differing ones always leave a mask untouched."""
    rng = np.random.default_rng(6)
    for w in (2, 4, 5, 13, 38):
        bits = [1 << int(b) for b in rng.choice(64, w, replace=False)]
        masks = [m & (1 << 64) - 1 for m in block_masks(3, sum(bits))]
        assert all(m | sum(bits) == (1 << 64) - 1 for m in masks)
        for _ in range(50):
            x = sum(rng.permutation(np.array(bits, object))[:3].tolist())
            assert any(m & x == 0 for m in masks)


def test_given_documents_against_brute_force(spark):
    """Every document of a given table: fingerprint and component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, slow_simhash(r.text)) for r in docs.select("doc_id", "text").collect()]
    label = brute_classes(np.array([p for _, p in rows], np.uint64))
    least = {}
    for (i, _), c in zip(rows, label.tolist()):
        least[c] = min(least.get(c, i), i)
    got = {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_groups(docs).collect()}
    assert got == {(i, p, least[c]) for (i, p), c in zip(rows, label.tolist())}


def test_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(e.unionByName(spark.createDataFrame([(1000, 1001)], "u long, v long"))).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_awkward_groups_and_one_kept(awkward, nothing):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash_groups(awkward).collect()}
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert len(got) == len({i for i, _ in rows})
    assert {got[i] for i in (100, 101, 102)} == {(0, 100)} and got[105][1] == 104 and got[None][1] is None
    assert all(got[i][0] & (1 << 64) - 1 == slow_simhash(t) for i, t in rows)
    kept = keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted({str(c) for _, c in got.values()})
    assert simhash_groups(nothing).count() == 0 and keep_one(nothing).count() == 0


def test_one_kept_of_each_component_with_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (7, d)]
    assert len({slow_simhash(t) for t in (a, b, c, d)}) == 4
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(None, a), (None, b), (5, c), (5, d)]))
