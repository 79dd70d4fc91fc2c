"""Run registered queries in Spark and their SQL oracles in DuckDB; compare results.

usage: python scripts/oracle_check.py [--sf DIR] [name ...]
Prints one line per query: rows (spark/oracle), column match, value match, seconds.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None  # pandas turns NULLs of nullable ints into NaN
        return v if os.environ.get("EXACT") else round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()

    import duckdb

    from tokenloom.plans import ORACLE, QUERIES
    from tokenloom.session import build_session

    spark = build_session(shuffle_partitions=8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = a.names or sorted(QUERIES)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = QUERIES[n](spark, a.sf)
            sp = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{n:34s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ORACLE:
            print(f"{n:34s} rows={len(sp):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            od = con.execute(ORACLE[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{n:34s} ORACLE-ERROR {str(e)[:300]}")
            bad += 1
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(od)
        ok = c1 == c2 and r1 == r2
        bad += not ok
        msg = ""
        if c1 != c2:
            msg = f" cols spark={c1} oracle={c2}"
        elif r1 != r2:
            diff = [(x, y) for x, y in zip(r1, r2) if x != y][:2]
            msg = f" first diffs: {diff}"[:600]
        dtypes = ""
        if ok:
            st = dict(sdf.dtypes)
            dtypes = " " + ",".join(f"{c}:{st[c]}/{od[c].dtype}" for c in c1)
        print(f"{n:34s} rows={len(r1):7d}/{len(r2):7d} {'OK  ' if ok else 'FAIL'} {ts:.1f}s{msg}"
              f"{dtypes if os.environ.get('SHOW_TYPES') else ''}")
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
