"""Registered queries: SQL oracles at sf0.001, names, and that the operators run on awkward and empty tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tokenloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(cols, values):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want, got = con.sql(ORACLE[name]), QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
