"""License scans by template markup matching.

A template is a license notice with markup: words outside it are mandatory, ``<<optional>> ... <<end>>`` may be absent (and
nest), ``<<var words="a-b">>original<<end>>`` stands for any a to b words, ``<<var match="x|y">>original<<end>>`` for one of the
given phrases (an empty one for none). A template is compiled into a token automaton: its states are places between words, its
edges a word, any word, or nothing. All templates share one automaton, whose deterministic states are built as texts reach
them. A text is accepted where the automaton runs over a stretch of its words to a template's end, so mandatory wording
matches exactly and nothing else but the markup's regions may differ.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. Base phrases are counted at every place
their words stand consecutively. Texts are read whole, a megabyte at a time with the automaton's runs carried
over, row by row: no shuffle, and a lost executor costs its batches. Defined cases: null and empty texts have no words, no
labels and score 0; a notice that occurs many times gives its label once; overlapping phrases all count; repeated rows and
ids are rows like any other; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 1 << 20
STATES = 1 << 14  # deterministic states kept; beyond them the table is emptied and built anew

#: Phrases of the base labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public notices and short licenses, as (label, template).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", '<<var match="licensed|released|distributed">>Licensed<<end>> under <<optional>>the terms of <<end>>the '
     'Apache License<<optional>>, Version<<end>> 2.0'),
    ("mit", '<<var match="licensed|released|distributed">>Released<<end>> under <<optional>>the terms of <<end>>'
     '<<optional>>the <<end>>MIT License'),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var words="1-12">>this software '
     'and associated documentation files (the "Software")<<end>>, to deal in the <<var match="software|materials">>Software'
     '<<end>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
     'sublicense, and/or sell copies of the <<var match="software|materials">>Software<<end>>, and to permit persons to whom the '
     '<<var match="software is|materials are">>Software is<<end>> furnished to do so, subject to the following conditions: The '
     'above copyright notice and this permission notice <<optional>>(including the next paragraph) <<end>>shall be included in '
     'all copies or substantial portions of the <<var match="software|materials">>Software<<end>>.'),
    ("gpl-3.0", '<<optional>>This work is <<end>>licensed under the <<optional>>terms of the <<end>>GNU General Public License'
     '<<optional>> as published by the Free Software Foundation<<end>><<optional>>, either<<end>><<optional>>, version<<end>> 3'),
    ("gpl-2.0", 'licensed under the <<optional>>terms of the <<end>>GNU General Public License<<optional>> as published by the '
     'Free Software Foundation<<end>><<optional>>, either<<end>><<optional>>, version<<end>> 2'),
    ("gpl-3.0", 'you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the '
     'Free Software Foundation, either version 3 of the License'),
    ("gpl-2.0", 'you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the '
     'Free Software Foundation; either version 2 of the License'),
    ("lgpl", '<<var match="gnu lesser general public license|gnu library general public license">>GNU Lesser General Public '
     'License<<end>>'),
    ("agpl-3.0", 'GNU Affero General Public License<<optional>> as published by the Free Software Foundation<<end>>'
     '<<optional>>, either<<end>><<optional>>, version<<end>> 3'),
    ("cc-by-nc-4.0", 'licensed under <<optional>>a <<end>><<var match="cc by nc|creative commons attribution noncommercial|'
     'creative commons attribution non commercial">>CC BY-NC<<end>> 4.0'),
    ("cc-by-sa-4.0", 'licensed under <<optional>>a <<end>><<var match="cc by sa|creative commons attribution sharealike|'
     'creative commons attribution share alike">>CC BY-SA<<end>> 4.0'),
    ("cc-by-4.0", 'licensed under <<optional>>a <<end>><<var match="cc by|creative commons attribution">>CC BY<<end>> 4.0'),
    ("mpl-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
    ("isc", 'Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without '
     'fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ("bsd-2-clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that '
     'the following conditions are met: <<optional>>1. <<end>>Redistributions of source code must retain the above copyright '
     'notice, this list of conditions and the following disclaimer. <<optional>>2. <<end>>Redistributions in binary form must '
     'reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or '
     'other materials provided with the distribution. <<optional>>THIS SOFTWARE IS PROVIDED BY <<var words="1-20">>THE COPYRIGHT '
     'HOLDERS AND CONTRIBUTORS<<end>> AS IS<<end>>'),
    ("bsd-3-clause", 'other materials provided with the distribution. <<optional>>3. <<end>>Neither the name of <<var words="1-20">>'
     'the copyright holder<<end>> nor the names of <<var match="its|his|her|their|the">>its<<end>> contributors may be used to '
     'endorse or promote products derived from this software without specific prior written permission.'),
    ("unlicense", 'This is free and unencumbered software released into the public domain.'),
    ("spdx", 'SPDX License Identifier <<var words="1-1">>MIT<<end>>'),
)

_SEPARATOR = bytes(32 if (i < 48 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 127) else i + 32 if 65 <= i <= 90 else i
                   for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATOR).split()


@dataclass
class Node:
    """A piece of a template: ``kind`` is words, optional, any or choice."""

    kind: str
    words: list[str] = field(default_factory=list)
    parts: list[Node] = field(default_factory=list)
    least: int = 0
    most: int = 0
    choices: list[list[str]] = field(default_factory=list)


_MARK = re.compile(r'<<(optional|end|var\s+(words|match)="([^"]*)")>>')


def parse(template: str) -> list[Node]:
    """The pieces of a template, in order."""
    stack: list[list[Node]] = [[]]
    open_: list[Node] = []
    at = 0

    def text(s: str) -> None:
        w = [x.decode() for x in words_of(s.encode())]
        if w and not (open_ and open_[-1].kind in ("any", "choice")):  # the original wording of a region isn't matched
            stack[-1].append(Node("words", w))

    for m in _MARK.finditer(template):
        text(template[at:m.start()])
        at = m.end()
        if m[1] == "end":
            if not open_:
                raise ValueError(f"<<end>> without a beginning at {m.start()}")
            node = open_.pop()
            node.parts = stack.pop()
            stack[-1].append(node)
            continue
        if open_ and open_[-1].kind != "optional":
            raise ValueError(f"markup within a replaceable region at {m.start()}")
        if m[1] == "optional":
            node = Node("optional")
        elif m[2] == "words":
            least, most = map(int, m[3].split("-"))
            node = Node("any", least=least, most=most)
        else:
            node = Node("choice", choices=[[w.decode() for w in words_of(c.encode())] for c in m[3].split("|")])
        open_.append(node)
        stack.append([])
    text(template[at:])
    if open_:
        raise ValueError(f"{len(open_)} regions without <<end>>")
    return stack[0]


def pattern(nodes: list[Node]) -> str:
    """The pieces as a regular expression over words that each end in a blank."""
    out = []
    for n in nodes:
        if n.kind == "words":
            out.append("".join(f"{w} " for w in n.words))
        elif n.kind == "optional":
            out.append(f"(?:{pattern(n.parts)})?")
        elif n.kind == "any":
            out.append(f"(?:[^ ]+ ){{{n.least},{n.most}}}")
        else:
            out.append("(?:" + "|".join("".join(f"{w} " for w in c) for c in n.choices) + ")")
    return "".join(out)


class Automaton:
    """All templates as one token automaton; runs are sets of places, numbered as they are first reached."""

    def __init__(self, templates: Iterable[tuple[str, list[Node]]]):
        self.by_word: list[dict[bytes, list[int]]] = []  # place -> word -> next places
        self.any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.ends: dict[int, int] = {}  # place -> template
        self.labels: list[str] = []
        start = self._place()
        for label, nodes in templates:
            self.ends[self._add(nodes, start)] = len(self.labels)
            self.labels.append(label)
        if any(p in self.ends for p in self._closed([start])):
            raise ValueError("a template matches no words at all")
        self.start = self._closed([start])
        self.vocabulary = {w for edges in self.by_word for w in edges}
        self._reset()
        # words that can begin a run; any other leaves the start
        self.first = None if any(self.any[p] for p in self.start) else {w for p in self.start for w in self.by_word[p]}

    def _place(self) -> int:
        self.by_word.append({})
        self.any.append([])
        self.free.append([])
        return len(self.any) - 1

    def _words(self, words: list[str], at: int) -> int:
        for w in words:
            to = self._place()
            self.by_word[at].setdefault(w.encode(), []).append(to)
            at = to
        return at

    def _add(self, nodes: list[Node], at: int) -> int:
        for n in nodes:
            if n.kind == "words":
                at = self._words(n.words, at)
                continue
            after = self._place()
            if n.kind == "optional":
                inner = self._place()
                self.free[at] += [inner, after]
                self.free[self._add(n.parts, inner)].append(after)
            elif n.kind == "any":
                for i in range(n.most + 1):
                    if i >= n.least:
                        self.free[at].append(after)
                    if i < n.most:
                        to = self._place()
                        self.any[at].append(to)
                        at = to
            else:
                for c in n.choices:
                    begin = self._place()
                    self.free[at].append(begin)
                    self.free[self._words(c, begin)].append(after)
            at = after
        return at

    def _closed(self, places: Iterable[int]) -> frozenset[int]:
        seen, todo = set(places), list(places)
        while todo:
            for p in self.free[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return frozenset(seen)

    def _reset(self) -> None:
        self.number: dict[frozenset[int], int] = {}
        self.places: list[frozenset[int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.next: list[dict[bytes, int]] = []
        self.begin = self._state(self.start)

    def _state(self, places: frozenset[int]) -> int:
        n = self.number.get(places)
        if n is None:
            n = self.number[places] = len(self.places)
            self.places.append(places)
            self.accepts.append(tuple(sorted({self.ends[p] for p in places if p in self.ends})))
            self.next.append({})
        return n

    def step(self, state: int, word: bytes) -> int:
        """The state after ``word``, -1 if no run goes on."""
        word = word if word in self.vocabulary else b""
        to = self.next[state].get(word)
        if to is None:
            here = self.places[state]
            reached = self._closed([q for p in here for q in (*self.by_word[p].get(word, ()), *self.any[p])])
            to = self._state(reached) if reached else -1
            self.next[state][word] = to
        return to


@dataclass
class Found:
    """What a text holds: words, places of the base phrases (start, label) counted, and accepted stretches."""

    n_words: int = 0
    n_base: int = 0
    first: int | None = None
    last: int | None = None
    base: set[str] = field(default_factory=set)
    accepted: dict[int, tuple[int, int]] = field(default_factory=dict)  # template -> first stretch (start, end)


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.automaton = Automaton((label, parse(t)) for label, t in templates)
        phrases = [(words_of(p.encode()), label) for p, label in base]
        self.longest = max((len(p) for p, _ in phrases), default=0)
        self.by_first: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for p, label in phrases:
            self.by_first.setdefault(p[0], []).append((p, label))

    def _base(self, words: list[bytes], at: int, usable: int, out: Found) -> None:
        """Phrases that start within the first ``usable`` of ``words``, whose first is word ``at`` of the text."""
        by_first = self.by_first
        for i in [i for i, w in enumerate(words[:usable]) if w in by_first]:
            for p, label in by_first[words[i]]:
                if words[i:i + len(p)] == p:
                    out.n_base += 1
                    out.first = at + i if out.first is None else min(out.first, at + i)
                    out.last = at + i if out.last is None else max(out.last, at + i)
                    out.base.add(label)

    def scan(self, text: str | None) -> Found:
        out, auto, runs = Found(), self.automaton, []
        kept: list[bytes] = []  # the last words, in which a base phrase may have begun
        if len(auto.places) > STATES:
            auto._reset()
        for part in _pieces(text.encode("utf-8", "surrogatepass") if text else b""):
            words = words_of(part)
            at = out.n_words
            both = kept + words
            usable = max(0, len(both) - self.longest + 1)
            self._base(both, at - len(kept), usable, out)
            kept = both[usable:]
            runs = self._run(words, at, runs, out)
            out.n_words += len(words)
        self._base(kept, out.n_words - len(kept), len(kept), out)
        return out

    def _run(self, words: list[bytes], at: int, runs: list[tuple[int, int]], out: Found) -> list[tuple[int, int]]:
        """Runs carried over, and those that begin in ``words``, as far as they go; those still going at the end."""
        auto, first, going = self.automaton, self.automaton.first, []
        starts = [(i, auto.begin, at + i) for i, w in enumerate(words) if first is None or w in first]
        nxt, accepts, vocabulary, n = auto.next, auto.accepts, auto.vocabulary, len(words)
        for i, state, start in [*((0, s, b) for s, b in runs), *starts]:
            while i < n:
                w = words[i]
                to = nxt[state].get(w if w in vocabulary else b"")
                state = auto.step(state, w) if to is None else to
                if state < 0:
                    break
                i += 1
                if accepts[state]:
                    for t in accepts[state]:
                        out.accepted.setdefault(t, (start, at + i))
            else:
                going.append((state, start))
        return going

    def labels(self, found: Found) -> set[str]:
        return found.base | {self.automaton.labels[t] for t in found.accepted}

    def score(self, found: Found) -> float:
        """1 where a template is accepted, 0.5 where only a base phrase stands, else 0."""
        return 1.0 if found.accepted else 0.5 if found.n_base else 0.0


def _pieces(b: bytes) -> Iterator[bytes]:
    """The text in stretches of about a megabyte, none of which begins or ends within a word."""
    at = 0
    while at < len(b):
        end = min(len(b), at + PIECE)
        while end < len(b) and _SEPARATOR[b[end]] != 32:
            end += 1
        yield b[at:end]
        at = end


def scan(text: Column, templates=TEMPLATES, base=BASE) -> Column:
    """Struct (n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of each text.

    ``matches`` holds the first stretch (label, template number, first word, word after the last) of every accepted template.
    """
    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                  "score double, matches array<struct<label:string,template:int,start:long,stop:long>>")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Scanner(templates, base)
        for batch in texts:
            rows = []
            for t in batch:
                f = s.scan(t)
                stretches = [{"label": s.automaton.labels[k], "template": k, "start": a, "stop": b}
                             for k, (a, b) in sorted(f.accepted.items())]
                rows.append((f.n_words, f.n_base, f.first, f.last, ",".join(sorted(f.base)), ",".join(sorted(s.labels(f))),
                             s.score(f), stretches))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                                              "matches"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})
    return udf(text)
