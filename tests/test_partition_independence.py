"""Registered queries give the same rows whatever the shuffle partitioning (SURVEY §5 (4))."""

import pytest

from tokenloom.plans import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["packed_sequences", "domain_specialization", "balanced_binary", "span_segments", "subsequence_hits",
         "named_splits", "chat_render", "balanced_nary"]


def _rows(spark, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_for_1_and_13_partitions(spark, name):
    base = _rows(spark, name)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert _rows(spark, name) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
