import numpy as np
import pytest

from tokenloom.llm.quality_knn import PIECE, SHAPES, classify, features, fit, keep_good
from tokenloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op6_quality"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert got.score.between(0, 1).all() and len(held) > 50
    assert (held.predicted == held.quality).mean() > 0.97


def test_blocked_votes_against_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = fit(docs, labels)
    x = np.stack([features(r.text) for r in docs.limit(40).collect()])
    got = m.scores(x)
    for v, s in zip(x, got):
        cos = 0
        for (part, weight, axes, root), zs in zip(m.spaces, (m.z[:, :48], m.z[:, 48:])):
            a = v[part] * weight
            z = (a / np.linalg.norm(a)) @ axes
            cos = cos + root * (zs @ (z / np.linalg.norm(z)))
        top = np.argsort(-cos)[:31]
        w = np.maximum(cos[top], 0) ** 8
        assert s == pytest.approx((w * m.y[top]).sum() / w.sum(), abs=1e-3)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted((r.doc_id, r.score) for r in classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, None), (None, 1), (999, 0), (7, 0)], "doc_id long, quality int")
    got = classify(awkward, labels).collect()
    assert len(got) == awkward.count()
    assert all(r.score == 0 for r in got if r.doc_id in (100, 101, 102))
    assert len({r.score for r in got if r.doc_id == 106}) == 1
    none = classify(awkward, labels.limit(0)).toPandas()
    assert set(none.score) == {0, 0.5} and classify(nothing, labels).count() == 0
    assert keep_good(awkward, labels).columns == awkward.columns


def test_long_text_is_read_whole():
    t = "word " * (PIECE // 4)
    assert features(t)[:SHAPES - 1] != pytest.approx(features(t + "LOUD!! " * PIECE)[:SHAPES - 1])
    assert np.isfinite(features("x" * (3 * PIECE))).all()


def test_labels_that_depend_on_vocabulary_alone(spark):
    """Plain texts of one shape: only their words tell good from bad."""
    rnd = np.random.default_rng(6)
    vocab = ["".join(rnd.choice(list("bcdfglmnrst")) + rnd.choice(list("aeiou")) for _ in range(3)) for _ in range(900)]
    common, good, bad = vocab[:300], vocab[300:600], vocab[600:]
    rows, labels = [], []
    for i in range(1500):
        own = good if i % 2 else bad
        words = [*rnd.choice(common, 30), *rnd.choice(own, 10)]
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    labels += [(10 ** 6 + i, i % 2) for i in range(20_000)]  # labels of absent documents take no place in the sample
    got = classify(spark.createDataFrame(rows, "doc_id long, text string"),
                   spark.createDataFrame(labels, "doc_id long, quality int"), threshold=0.5).toPandas()
    held = got[got.held_out]
    assert len(held) > 200 and (held.predicted == held.doc_id % 2).mean() > 0.9


def test_many_distinct_words_are_counted_in_parts(monkeypatch):
    from tokenloom.llm import quality_knn
    t = " ".join(f"w{i % 700}" for i in range(3000))
    monkeypatch.setattr(quality_knn, "PIECE", 500)
    whole = features(t)
    monkeypatch.setattr(quality_knn, "MOST_WORDS", 10)
    np.testing.assert_allclose(features(t)[SHAPES:], whole[SHAPES:], rtol=1e-6)
