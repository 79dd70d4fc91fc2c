"""The pipeline's stages against plain reckonings on each stage's own input."""

import pytest

import corpus_pipeline
from tokenloom.llm.common import staged, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_columns_and_rows(spark, steps):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "sentencepiece"]
    for s in steps[:-1]:
        assert s.columns == docs.columns
    n = [docs.count(), *(s.count() for s in steps)]
    assert n[0] >= n[1] == n[2] >= n[3] and n[4] == n[5] > 0


def test_clean_labelled_documents_stay(spark, steps):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in steps[0].collect()}
    good, bad = ([i for i, q in labels.items() if q == k] for k in (1, 0))
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_one_of_each_group(steps):
    from test_llm_simhash import slow_simhash
    prints = sorted({slow_simhash(r.text) for r in steps[1].collect()})
    left = [slow_simhash(r.text) for r in steps[2].collect()]
    assert len(left) == len(set(left))
    assert all(bin(a ^ b).count("1") > 3 for k, a in enumerate(left) for b in left[:k])
    assert all(any(bin(a ^ b).count("1") <= 3 for b in left) or a in left for a in prints)


def test_run_gives_the_last_stage(spark, steps):
    run = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert run == sorted(map(tuple, steps[-1].collect())) and corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, SF), f"test-{name}")
    assert docs.count() == 0


def test_short_boilerplate_goes(spark):
    rows = [(i, f"Les.\n\nown line of document {i}\n }} ", f"s{i}") for i in range(6)] + [(6, "rare\nLes.", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, SF).collect()}
    assert got == {0: rows[0][1], 6: "rare", **{i: f"\nown line of document {i}" for i in range(1, 6)}}


def test_awkward_table_through_all_stages(spark, awkward):
    """Null and repeated ids, null, empty and very long texts, equal rows and columns named like the operators' own."""
    docs, sizes = staged(awkward, "test-awkward"), []
    for name, f in corpus_pipeline.STAGES:
        out = staged(f(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns or name == "sentencepiece"
        sizes.append(out.count())
        docs = out
    # no label is of these documents: texts without words go, all others stay; 106 is there twice, 104 and 105 agree
    n = awkward.count()
    assert sizes[0] == sizes[1] == n - 3 and sizes[2] < sizes[0] and sizes[4] == sizes[3] >= sizes[2]
