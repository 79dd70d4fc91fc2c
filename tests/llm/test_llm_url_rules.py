import random
import time

import pytest
from pyspark.sql import functions as F

from tokenloom.llm.url_rules import given_rule, host_of, judge, matched, mine_rules, path_of, tokens_of


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/de/1", "example.net", "/de/1", "net/", "block"),
    ("https://x.example.com/de/#t", "x.example.com", "/de/", "example.com/de/", "block"),
    ("https://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("ftp://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, None),
    ("http://a.net?x=/", "a.net", "", None, None),
    ("http://É.net/", "É.net", "/", "net/", "block"),
    ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("x://y://z/p", "y:", "//z/p", None, None)])
def test_host_path_rule(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url,)], "u string").select(host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    r, v = given_rule(F.col("h"), F.col("p"))
    assert tuple(df.select("h", "p", r, v).first()) == (host, path, rule, verdict)


def test_tokens(spark):
    df = spark.createDataFrame([("http://www.a.com/en/12.html?page=2&ref=x&page=3#top",), (None,)], "u string")
    a, b = (r[0] for r in df.select(tokens_of(F.col("u"))).collect())
    assert a == ["h:www", "h:a", "h:com", "p:en", "p:#.html", "q:page", "q:ref", "f:top"] and not b


def fixture(spark):
    rows = []
    for i in range(300):
        host = ["good.com", "bad.com", "mixed.org"][i % 3]
        rows.append((i, f"http://{host}/{'spam' if i % 4 == 0 else 'news'}/{i}{'?ref=x' if i % 5 == 0 else ''}"))
    rows += [(1000 + i, "http://mixed.org/spam/1") for i in range(200)] + [(2000, None), (2001, "nothing")]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, verdict string")
    bad = {i: "bad.com" in (u or "") or "mixed.org/spam" in (u or "") for i, u in rows if i % 2 == 0}
    return rows, pages, spark.createDataFrame(sorted(bad.items()), "page_id long, bad boolean"), bad


def brute(spark, rows, bad, least, confidence, gain=0.01):
    """Rules whose every token pays, over the first of each class of tokens that always come together; members by class."""
    urls = {u for _, u in rows if u}
    tok = {r.u: frozenset(r.t) for r in spark.createDataFrame([(u,) for u in urls], "u string")
           .select("u", tokens_of(F.col("u")).alias("t")).collect()}
    baskets = [(tok.get(u, frozenset()), bad[i]) for i, u in rows if i in bad]
    where = {t: tuple(k for k, (b, _) in enumerate(baskets) if t in b) for b, _ in baskets for t in b}
    rep = {t: min(o for o in where if where[o] == where[t]) for t in where}
    kept, level = {frozenset(): sum(b for _, b in baskets) / len(baskets)}, [frozenset([t]) for t in set(rep.values())]
    while level:
        now = {}
        for c in level:
            has = sum(c <= t for t, _ in baskets)
            both = sum(c <= t and b for t, b in baskets)
            if both >= least and all(both / has >= kept.get(c - {t}, 9) + gain for t in c):
                now[c] = both / has
        kept |= now
        level = {c | d for c in now for d in now if len(c | d) == len(c) + 1}
    rules = {c: v for c, v in kept.items() if c and v >= confidence}
    return {u: frozenset(rep.get(x) for x in t) for u, t in tok.items()}, rules


def compare(rules, want):
    assert {frozenset(r.antecedent): round(r.confidence, 9) for r in rules.collect()} == {c: round(v, 9) for c, v in want.items()}


@pytest.mark.parametrize("dense", [0, 99])
def test_rules_and_matches_against_brute_force(spark, dense):
    rows, pages, bad_df, bad = fixture(spark)
    tok, want = brute(spark, rows, bad, 4, 0.6)
    assert max(map(len, want)) > 1
    rules, members = mine_rules(pages, bad_df, min_support=0, min_rows=4, min_confidence=0.6, dense=dense)
    compare(rules, want)
    got = {r.u: r.confidence for r in matched(pages.select(F.col("url").alias("u")).dropna().distinct(), rules, members).collect()}
    best = {u: max((v for c, v in want.items() if c <= t), default=None) for u, t in tok.items()}
    assert {u: round(v, 9) for u, v in got.items()} == {u: round(v, 9) for u, v in best.items() if v is not None}


def test_verdicts(spark):
    rows, pages, bad_df, _ = fixture(spark)
    got = judge(pages, bad_df, min_support=0.02, min_rows=1, min_confidence=0.9).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "block" if r.host == "bad.com" or r.host == "mixed.org" and r.path.startswith("/spam") else "allow"
        assert (r.rule, r.verdict) == (None, want), r
    none = judge(pages, bad_df.limit(0)).select("verdict").distinct().collect()
    assert [r.verdict for r in none] == ["allow"] and judge(pages.limit(0), bad_df).count() == 0


def test_marks_after_many_tokens_are_mined(spark):
    """Query keys and fragments behind a long path, some of which always come together."""
    path = "/".join(f"part{x}" for x in "abcdefghi")
    rows = [(i, f"http://www.site.com/{path}/{'x' if i % 2 else 'y'}?utm=1&ref=2{'&spam=3' if i % 4 == 0 else ''}"
                f"{'#win' if i % 5 == 0 else ''}{'#top' if i % 7 == 0 else ''}") for i in range(80)]
    bad = {i: i % 4 == 0 and i % 3 > 0 or i % 5 == 0 for i, _ in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string")
    _, want = brute(spark, rows, bad, 4, 0.4)
    rules, _ = mine_rules(pages, spark.createDataFrame(sorted(bad.items()), "page_id long, bad boolean"), min_support=0,
                          min_rows=4, min_confidence=0.4)
    compare(rules, want)
    assert frozenset({"q:spam"}) in want and frozenset({"f:win"}) in want


def optional(k, n, share, seed):
    """URLs with ``k`` query keys, each there with probability ``share``; some keys make the label likelier, two only together."""
    rnd = random.Random(seed)
    rows = [(i, "http://site.com/p?" + "&".join(f"k{j}=1" for j in range(k) if rnd.random() < share) + f"&id{i}") for i in range(n)]
    bad = {i: rnd.random() < 0.2 + 0.25 * ("k1=" not in u) + 0.3 * ("k2=" in u and "k3=" in u) + 0.1 * ("k4=" in u) for i, u in rows}
    return rows, bad


@pytest.mark.parametrize("share,dense", [(0.97, 10), (0.6, 0), (0.6, 99)])
def test_optional_keys_against_brute_force(spark, share, dense):
    rows, bad = optional(12, 400, share, 4)
    _, want = brute(spark, rows, bad, 5, 0.5)
    rules, _ = mine_rules(spark.createDataFrame(rows, "page_id long, url string"),
                          spark.createDataFrame(sorted(bad.items()), "page_id long, bad boolean"), dense=dense)
    compare(rules, want)
    assert share > 0.9 or max(map(len, want)) > 2


@pytest.mark.parametrize("share", [0.97, 0.5])
def test_many_optional_keys_end_soon(spark, share):
    rows, bad = optional(25, 1000, share, 5)
    start = time.time()
    rules, members = mine_rules(spark.createDataFrame(rows, "page_id long, url string"),
                                spark.createDataFrame(sorted(bad.items()), "page_id long, bad boolean"))
    assert rules.count() < 20_000 and time.time() - start < 60


def test_long_runs_stay_one_rule_and_long_urls(spark):
    """Three runs of 24 segments that always come together are one rule; URLs of a megabyte are matched whole."""
    runs = ["/".join(f"{r}seg{chr(97 + j)}" for j in range(24)) for r in "xyz"]
    rows = [(i, "http://h.com/" + "/".join(runs[r] for r in range(3) if i >> r & 1) + "/end") for i in range(400)]
    bad = {i: i % 8 == 7 for i, _ in rows}
    long = [(9000, "http://h.com/" + "pad/" * 200_000 + "/".join(runs) + "?" + "&".join(f"q{j}x" for j in range(3000))), (9001, "http://h.com/" + "p" * 1_000_000)]
    pages = spark.createDataFrame(rows + long, "page_id long, url string")
    bad_df = spark.createDataFrame(sorted(bad.items()), "page_id long, bad boolean")
    rules, members = mine_rules(pages, bad_df, min_confidence=0.9)
    assert rules.count() == 1 and members.count() == 72
    got = {r.page_id: r.verdict for r in judge(pages, bad_df, min_confidence=0.9).collect()}
    assert got == {**{i: "block" if b else "allow" for i, b in bad.items()}, 9000: "block", 9001: "allow"}


@pytest.mark.parametrize("dense", [0, 2, 5, 10])
def test_fp_growth_finds_the_combinations_of_every_basket(spark, monkeypatch, dense):
    """Whatever the baskets hold: it isn't left out where tokens combine in none, nor replaced where many do, and combinations
    of ``min_rows`` baskets are in (5 / 147 * 147 > 5)."""
    from tokenloom.llm import url_rules

    fitted, seen = [], []

    class Spy(url_rules.FPGrowth):
        def fit(self, df):
            fitted.append(df.selectExpr("max(size(items))").first()[0])
            model = super().fit(df)
            seen.append(model.freqItemsets.selectExpr("max(size(items))").first()[0])
            return model

    monkeypatch.setattr(url_rules, "FPGrowth", Spy)
    rows = [(i, "http://h.com/" + "/".join("abcdefgh"[j] for j in range(8) if j < 4 and i < 5 or (i * 31 + j * 17) % 5 < 2)) for i in range(147)]
    bad = {i: i < 5 or i % 9 == 0 for i, _ in rows}
    _, want = brute(spark, rows, bad, 5, 0.5)
    assert max(map(len, want)) > 1
    rules, _ = mine_rules(spark.createDataFrame(rows, "page_id long, url string"),
                          spark.createDataFrame(sorted(bad.items()), "page_id long, bad boolean"), dense=dense)
    compare(rules, want)
    assert max(seen) > 1 and max(fitted) <= max(dense, 1) + 1

    fitted.clear()
    rows = [(i, f"x://{'ab'[i % 2]}") for i in range(40)]  # tokens that never meet
    bad = {i: i % 2 == 0 for i, _ in rows}
    rules, _ = mine_rules(spark.createDataFrame(rows, "page_id long, url string"),
                          spark.createDataFrame(sorted(bad.items()), "page_id long, bad boolean"), dense=dense)
    assert [(r.antecedent, r.confidence) for r in rules.collect()] == [(["h:a"], 1.0)] and fitted
