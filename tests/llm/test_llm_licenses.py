"""License scans: markup, automaton against regular expressions, long texts in pieces, awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import license_scan
from tokenloom.llm.license_scan import BASE, TEMPLATES, Automaton, Scanner, parse, pattern, scan, words_of


def slow(text, templates, base=BASE):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
    at = [(i, label) for p, label in base for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    joined = " " + "".join(x + " " for x in w)
    method = {label for label, x in templates if re.search(" " + pattern(parse(x)), joined)}
    base_labels = {label for _, label in at}
    return (len(w), len(at), min(i for i, _ in at) if at else None, max(i for i, _ in at) if at else None,
            ",".join(sorted(base_labels)), ",".join(sorted(base_labels | method)), 1.0 if method else 0.5 if at else 0.0)


def fast(text, templates=TEMPLATES):
    s = Scanner(templates)
    f = s.scan(text)
    return (f.n_words, f.n_base, f.first, f.last, ",".join(sorted(f.base)), ",".join(sorted(s.labels(f))), s.score(f))


NOTICES = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "licensed under CC BY-NC 4.0",
           "This work is licensed under the GNU General Public License, version 3.", "MIT License. mit LICENSE",
           "licensed under the Apache License Version 2.1", "SPDX-License-Identifier: ISC", "GNU Lesser General Public License",
           "Released under the terms of the Mit\tLicense", "", None, "ÀB naïve Ünlicensed under CC BY 4.0 é4"]


@pytest.mark.parametrize("text", NOTICES)
def test_notices(text):
    assert fast(text) == slow(text, TEMPLATES)


def test_every_template_accepts_its_original():
    for label, t in TEMPLATES:
        original = re.sub(r"<<[^>]*>>", "", t)
        s = Scanner([(label, t)])
        assert list(s.scan(f"some words before. {original} and after").accepted) == [0], label
        nodes = parse(t)
        word = next((n.words[0] for n in nodes if n.kind == "words"), None) or nodes[0].choices[0][0]
        broken = re.sub(rf"(?i)\b{word}\b", "otherword", original)
        assert not s.scan(broken).accepted, label


def test_random_templates_against_regular_expressions():
    rnd = random.Random(3)

    def piece(depth):
        kind = rnd.choice(["w", "w", "o", "a", "c"]) if depth < 2 else "w"
        if kind == "w":
            return rnd.choice("abc") + " "
        if kind == "o":
            return "<<optional>>" + "".join(piece(depth + 1) for _ in range(rnd.randint(1, 2))) + "<<end>>"
        if kind == "a":
            low = rnd.randint(0, 2)
            return f'<<var words="{low}-{low + rnd.randint(0, 2)}">>x y<<end>>'
        return '<<var match="a b|c|">>z<<end>>'
    for k in range(300):
        templates = [(f"l{i}", "a " + "".join(piece(0) for _ in range(rnd.randint(1, 4))) + rnd.choice(["b", "c"])) for i in range(3)]
        text = " ".join(rnd.choice(["a", "b", "c", "d"]) for _ in range(rnd.randint(0, 25)))
        assert fast(text, templates) == slow(text, templates), (templates, text)


def test_pieces_and_emptied_states(monkeypatch):
    text = ("filler words of any kind, " * 40).join(x or "" for x in NOTICES) + " the GNU general public"
    want = slow(text, TEMPLATES)
    assert fast(text) == want
    for size in (1, 7, 64):
        monkeypatch.setattr(license_scan, "PIECE", size)
        monkeypatch.setattr(license_scan, "STATES", 3)
        assert fast(text) == want
        assert [len(words_of(p)) <= size for p in license_scan._pieces(b"a b cd")] == [True] * len(list(license_scan._pieces(b"a b cd")))


def test_stretches_and_wrong_markup():
    s = Scanner([("x", 'one <<var words="0-3">>any<<end>> two')])
    assert s.scan("one two. one a b c two; one a b c d two").accepted == {0: (0, 2)}
    assert s.scan("one a b c d two").accepted == {}
    for bad in ("a <<end>>", "a <<optional>> b", '<<var words="1-2">> <<optional>> x <<end>> <<end>> a'):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        Automaton([("x", parse("<<optional>>a<<end>>"))])


def test_awkward_rows(awkward, nothing):
    more = awkward.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" Released under the MIT License")))
                              .otherwise(F.col("text"))).withColumn("labels", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = more.select("doc_id", "text", scan(F.col("text")).alias("x")).collect()
    assert len(got) == awkward.count()
    for r in got:
        x = r.x.asDict()
        assert tuple(x[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == slow(r.text, TEMPLATES)
        assert all(m.stop <= r.x.n_words and m.start < m.stop for m in r.x.matches)
    assert any(r.x.n_base for r in got)
    assert nothing.select(scan(F.col("text")).alias("x")).count() == 0
