"""Per-document mask queries give a row for every document, also for NULL, empty and blank texts."""

import pytest

from tokenloom.plans import QUERIES


@pytest.mark.parametrize("name,col", [("mask_to_token", "n_tokens"), ("char_to_token", "char_index"),
                                      ("badword_mask", "n_kept"), ("token_budget_mask", "n_tokens")])
def test_blank_documents_have_rows(spark, tmp_path, name, col):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "Ab cd ef gh")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r[col] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and None not in got.values()
    if col != "char_index":
        assert [got[i] for i in (1, 2, 3)] == [0, 0, 0] and got[4] > 0
