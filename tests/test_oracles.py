"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from oracle_check import TABLES, rows_of  # noqa: E402

from tokenloom.plans import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(sp.columns) > 0
        return
    od = duck.execute(ORACLE[name]).df()
    c1, r1 = rows_of(sp)
    c2, r2 = rows_of(od)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
