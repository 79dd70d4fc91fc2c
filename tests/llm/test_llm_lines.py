from collections import defaultdict

from tokenloom.llm.line_spread import dedup_lines, spread_lines
from tokenloom.llm.queries import QUERIES


def brute(rows, min_sites, min_chars):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for x in (text or "").split("\n"):
            k = x.strip(" \t\r")
            sites[k].add(site)
            first[k] = min(i, first.get(k, i))
    bad = {k for k, v in sites.items() if len(v) >= min_sites and len(k) >= min_chars}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (k := x.strip(" \t\r")) not in bad or first[k] == i)
            for i, t, _ in rows}


def test_against_brute_force(spark):
    rows = []
    for i in range(400):
        lines = [f"own line of document {i} here"]
        lines += [f"boilerplate number {j} on sites" for j in range(1, 12) if i % 20 < j]  # j sites carry line j
        rows.append((i, "\n".join(lines + ["short", "", f"\t own {i % 3} thing again \r"]), f"s{i % 20}"))
    rows += [(900, None, "s1"), (901, "", None), (902, "boilerplate number 11 on sites", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == brute(rows, 5, 1)
    assert {r.doc_id: r.text for r in dedup_lines(df, min_chars=16).collect()} == brute(rows, 5, 16)


def test_near_threshold_is_exact(spark):
    rows = [(i, f"line on {n} different sites", f"s{i}") for n in (3, 4, 5, 6, 7) for i in range(n)]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, text string, source string")
    assert spread_lines(df, min_sites=5).count() == 3


def test_awkward(awkward, nothing):
    out = dedup_lines(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert dedup_lines(nothing).count() == 0
    texts = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert texts == sorted((str(r.doc_id), str(r.text)) for r in awkward.collect())  # nothing spreads over five sources


def test_repeated_rows_and_null_ids(spark):
    line = "a line that many sites carry"
    rows = [(1, line, f"s{k}") for k in range(6)] + [(2, f"{line}\nown", "s0")] * 2 + [(None, line, "s1")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", line)] * 6 + [("2", "own")] * 2 + [("None", "")])


def test_the_query_judges_short_lines(spark, tmp_path):
    rows = [(i, f"Les.\n\nown {i}\n \t", f"s{i}") for i in range(6)] + [(6, "}\nLes.\nx", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (rows[0][1], 4, 0), 6: ("}\nx", 3, 1), **{i: (f"\nown {i}\n \t", 4, 1) for i in range(1, 6)}}
