import re

import pytest
from pyspark.sql import functions as F

from tokenloom.llm.pseudonyms import KINDS, Permutation, _luhn, _mod97, hide_private, pseudonymise, pseudonyms

P, BACK = Permutation(b"k"), Permutation(b"k", reverse=True)
SAMPLES = {
    "email": "Anna.Mueller+x1@mail.example.com", "iban": "GB82 WEST 1234 5698 7654 32", "ip": "192.168.0.1",
    "ssn": "665-45-6789", "date": "2021-02-28", "phone": "+1 (152) 555-8590", "card": "4111 1111 1111 1111"}


@pytest.mark.parametrize("kind", KINDS)
def test_same_format_and_reversible(kind):
    v = SAMPLES[kind]
    out, n = pseudonymise(f"see {v}, or {v}.", P)
    a, b = re.fullmatch(r"see (.*), or (.*)\.", out).groups()
    assert a == b != v and n == {kind: 2}
    assert pseudonymise(out, BACK)[0] == f"see {v}, or {v}."
    if kind != "ip":
        assert re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", a)) == re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", v))
    if kind == "card":
        assert _luhn(a.replace(" ", "")) == 0
    if kind == "iban":
        s = a.replace(" ", "")
        assert _mod97(s[4:] + s[:4]) == 1 and s[:2] == "GB"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 97, 1000])
def test_permutation_without_fixed_points(n):
    out = [P(x, n, "t") for x in range(n)]
    assert sorted(out) == list(range(n)) and (n == 1 or all(x != y for x, y in enumerate(out)))
    assert [BACK(y, n, "t") for y in out] == list(range(n))


@pytest.mark.parametrize("t", ["4111 1111 1111 1112", "2021-02-30", "300.1.1.1", "version 2.0.", "000-12-3456", "a@b", "1,234,567",
                               "12345678901234567890", "GB82 WEST 1234 5698 7654 33 no"])
def test_invalid_values_stay(t):
    assert pseudonymise(t, P)[0] == t


def test_neighbouring_values():
    t = "99.139.161.255 4111111111111111 +1 (269) 555-3296 4111111111111111 12 x..bob@example.org 31/12/1999 12/31/1999"
    out, n = pseudonymise(t, P)
    assert n == {"ip": 1, "card": 2, "phone": 1, "email": 1, "date": 2} and pseudonymise(out, BACK)[0] == t
    assert not set(re.findall(r"[\w.]{6,}", t)) & set(re.findall(r"[\w.]{6,}", out)) - {"example.org"}


def test_linked_across_documents_and_awkward_rows(spark, awkward, nothing):
    df = spark.createDataFrame([(1, "a 10.0.0.1"), (2, "b 10.0.0.1"), (3, None), (4, "c 10.0.0.2")], "doc_id long, text string")
    t = {r.doc_id: r.text for r in hide_private(df, b"k").collect()}
    assert t[1][2:] == t[2][2:] != t[4][2:] and t[3] is None
    out = hide_private(awkward, b"k")
    assert out.columns == awkward.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, awkward.collect()))
    assert nothing.select(pseudonyms(F.col("text"), b"k")).count() == 0


def test_long_tokens_are_quick():
    t = "a" * 300_000 + " " + "1" * 300_000 + " " + "1 " * 100_000 + "x." * 100_000
    assert pseudonymise(t, P)[0] == t


def test_a_day_and_an_address_have_one_pseudonym():
    for y, m, d in ((2000, 12, 31), (1999, 1, 12), (2024, 2, 29), (1900, 1, 1), (2099, 12, 13)):
        t = f"{y}-{m:02d}-{d:02d} {d:02d}.{m:02d}.{y} {m:02d}/{d:02d}/{y}" + (f" {d:02d}/{m:02d}/{y}" if d > 12 else "")
        out, n = pseudonymise(t, P)
        x = out.split()
        iso = x[0].split("-")
        assert n == {"date": len(x)} and (int(iso[2]) > 12) == (d > 12)
        assert x[1].split(".") == iso[::-1] and x[2].split("/") == [iso[1], iso[2], iso[0]]
        assert len(x) == 3 or x[3].split("/") == iso[::-1]
        assert pseudonymise(out, BACK)[0] == t
    a, b = pseudonymise("Anna.B@x.org anna.b@x.org", P)[0].split()
    assert a.lower() == b and a != b and pseudonymise(f"{a} {b}", BACK)[0] == "Anna.B@x.org anna.b@x.org"


def test_given_table_round_trip_and_links(spark):
    """Every document comes back whole; a value has one pseudonym in all documents, another value another one."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    emails = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    pairs, touched = set(), 0
    for t in docs:
        out, n = pseudonymise(t, P)
        assert pseudonymise(out, BACK)[0] == t and (out == t) == (not n)
        touched += bool(n)
        pairs |= set(zip(emails.findall(t or ""), emails.findall(out or "")))
    assert touched > 20 and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs) > 5
