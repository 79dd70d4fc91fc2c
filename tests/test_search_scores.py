import pytest
from pyspark.sql import functions as F

from tokenloom.operators.scores import argmax, cross_entropy, masked_loss, next_token_losses
from tokenloom.operators.search import find_in_row, find_subsequences


def test_find_in_row(spark):
    df = spark.createDataFrame([([1, 1, 1, 2, 1, 1], [1, 1]), ([1], [1, 1])], "s array<int>, p array<int>")
    rows = df.select(find_in_row("s", "p").alias("a"), find_in_row("s", "p", True).alias("f")).collect()
    assert rows[0].a == [0, 1, 4] and rows[0].f == [0] and rows[1].a == []


def test_find_subsequences_matches_brute_force(spark):
    docs = spark.createDataFrame([(1, list("abcabcab")), (2, list("xxabc")), (3, list("ab"))],
                                 "doc_id long, tokens array<string>")
    pats = spark.createDataFrame([(10, list("abc")), (11, list("ab")), (12, list("cabcab")), (13, [])],
                                 "item_id long, pattern array<string>")
    got = sorted(tuple(r) for r in find_subsequences(docs, pats, anchor=2, anchor_lengths=[2]).collect())
    want = []
    for d, t in [(1, "abcabcab"), (2, "xxabc"), (3, "ab")]:
        for i, p in [(10, "abc"), (11, "ab"), (12, "cabcab")]:
            want += [(i, d, k) for k in range(len(t) - len(p) + 1) if t[k:k + len(p)] == p]
    assert got == sorted(want)


def test_automaton_and_anchors_agree(spark):
    """Random sequences over few tokens, with separators, escapes, empty and missing tokens; equal patterns, many hits."""
    import random

    from tokenloom.operators.search import find_by_anchors

    rnd = random.Random(2)
    alphabet = ["a", "b", "", "\x1f", "\x1e", "\x1ea", "é😀"]
    docs = [(i, [rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))]) for i in range(60)] + [(100, None), (101, ["a", None, "a"])]
    pats = [(i, [rnd.choice(alphabet) for _ in range(rnd.randint(0, 4))]) for i in range(80)] + [(90, ["a", None]), (91, None)]
    d = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    p = spark.createDataFrame(pats, "item_id long, pattern array<string>")
    want = sorted((i, k, j) for i, x in pats if x and None not in x for k, t in docs if t
                  for j in range(len(t) - len(x) + 1) if t[j:j + len(x)] == x)
    assert want and sorted(map(tuple, find_subsequences(d, p).collect())) == want
    assert sorted(map(tuple, find_subsequences(d, p, automaton_tokens=0, anchor=2).collect())) == want
    assert sorted(map(tuple, find_by_anchors(d, p.where("NOT exists(pattern, x -> x IS NULL)"), anchor=3).collect())) == want
    firsts = {}
    for i, k, j in want:
        firsts[i, k] = min(j, firsts.get((i, k), j))
    assert {(r.item_id, r.doc_id): r.pos for r in find_subsequences(d, p, first_only=True).collect()} == firsts
    ids = spark.createDataFrame([("x", [1, 12, 1, 2]), ("y", [11, 2])], "doc_id string, tokens array<int>")
    one = spark.createDataFrame([(5, [1, 2])], "item_id long, pattern array<int>")
    assert [tuple(r) for r in find_subsequences(ids, one).collect()] == [(5, "x", 2)]
    assert find_subsequences(ids, one.limit(0)).count() == 0


def test_argmax_and_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [1.0, 2.0, 3.0])], "a array<double>, l array<double>")
    r = df.select(argmax("a").alias("am"), cross_entropy("l", F.lit(1)).alias("ce")).first()
    assert r.am == 1 and r.ce == pytest.approx(1.407606, abs=1e-6)


def test_masked_loss_shift(spark):
    rows = [(0, 0, [0.0, 0.0], 1, True), (0, 1, [0.0, 0.0], 0, True), (0, 2, [0.0, 0.0], 1, False)]
    df = spark.createDataFrame(rows, "seq int, pos int, logits array<double>, label int, imp boolean")
    losses = next_token_losses(df, seq="seq", pos="pos", logits="logits", label="label", important="imp")
    r = masked_loss(losses, by=["seq"]).first()
    assert r.loss == pytest.approx(0.693147, abs=1e-6)  # only position 0 (label at 1 is important)


def test_find_subsequences_short_patterns_by_default(spark):
    docs = spark.createDataFrame([(1, list("abcab"))], "doc_id long, tokens array<string>")
    pats = spark.createDataFrame([(10, list("ab")), (11, list("b")), (12, list("abcab"))],
                                 "item_id long, pattern array<string>")
    got = sorted(tuple(r) for r in find_subsequences(docs, pats, anchor=4).collect())
    assert got == [(10, 1, 0), (10, 1, 3), (11, 1, 1), (11, 1, 4), (12, 1, 0)]


def test_cross_entropy_is_linear_in_the_vocabulary(spark):
    import time

    def seconds(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: (x % 7).cast("double")).alias("v"))
        df = df.select(cross_entropy("v", F.lit(3)).alias("ce"))
        df.collect()
        t = time.perf_counter()
        df.collect()
        return time.perf_counter() - t

    seconds(100)
    assert seconds(200_000) < 20  # quadratic, this would take hours


def test_cross_entropy_of_null_and_empty(spark):
    df = spark.createDataFrame([(None, 0), ([], 0), ([1.0, 2.0], None), ([1.0, 1.0], 0)], "v array<double>, l int")
    got = [r[0] for r in df.select(cross_entropy("v", "l")).collect()]
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(0.6931471805599453)


def test_find_subsequences_skips_no_pattern_whatever_lengths_are_given(spark):
    docs = spark.createDataFrame([(1, list("abcab"))], "doc_id long, tokens array<string>")
    pats = spark.createDataFrame([(10, list("ab")), (11, list("b"))], "item_id long, pattern array<string>")
    got = sorted(tuple(r) for r in find_subsequences(docs, pats, anchor=4, anchor_lengths=[2]).collect())
    assert got == [(10, 1, 0), (10, 1, 3), (11, 1, 1), (11, 1, 4)]
