"""Licence texts in documents: matching statistics of a generalised suffix automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import word_blocks

# Phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening words of public licences and the usual lines that name them.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the "
                 "license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
]


def _gnu(name: str, version: str) -> str:
    return (f"under the terms of the {name} as published by the free software foundation either version {version} of "
            "the license or at your option any later version")


_GPL, _LGPL, _AGPL, _LIBRARY = (f"gnu {x}general public license" for x in ("", "lesser ", "affero ", "library "))
# Standard notices, headings and sections of common licences, with the runs of words
# that must be met whole, so that neither another licence of a family nor another version is taken for it.
NOTICES: list[tuple[str, str, tuple[str, ...]]] = [
    *((label, _gnu(name, v), (name, f"version {v} of the license")) for label, name, v in (
        ("gpl-2", _GPL, "2"), ("gpl-3", _GPL, "3"), ("lgpl-2", _LIBRARY, "2"), ("lgpl-2.1", _LGPL, "2 1"),
        ("lgpl-3", _LGPL, "3"), ("agpl-3", _AGPL, "3"))),
    # Other licences name these by version too; only the heading has the date.
    *((label, text, (text,)) for label, name, v, rest in (
        ("lgpl-2", _LIBRARY, "2", "june 1991"),
        ("gpl-2", _GPL, "2", "june 1991"), ("gpl-3", _GPL, "3", "29 june 2007"), ("lgpl-2.1", _LGPL, "2 1", "february 1999"),
        ("lgpl-3", _LGPL, "3", "29 june 2007"), ("agpl-3", _AGPL, "3", "19 november 2007"),
        ("mpl-2", "mozilla public license", "2 0", "")) for text in [f"{name} version {v} {rest}".strip()]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
              "distributed with this file you can obtain one at", ("mozilla public license v 2 0",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is "
                 "distributed on an as is basis without warranties or conditions of any kind either express or implied", ()),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free "
                 "irrevocable copyright license to reproduce prepare derivative works of", ()),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the software", ("substantial portions of the software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies", ()),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer", ()),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
            "following disclaimer in the documentation and or other materials provided with the distribution", ()),
    ("unlicense", "this is free and unencumbered software released into the public domain", ()),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code "
                  "form or as a compiled binary for any purpose commercial or non commercial and by any means", ()),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to",
     ("waived all copyright and related",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by", "creative commons attribution 4 0 international public license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
]
TEMPLATES += [(label, text) for label, text, _ in NOTICES]
# Runs of words of a template that a match must hold whole.
REQUIRED = {text: runs for _, text, runs in NOTICES} | {
    "creative commons attribution noncommercial 4 0 international license": ("noncommercial",),
    "this work is licensed under the gnu general public license version 3": (_GPL,),
}
# A match counts from this many words on; two of a chain lie at most GAP words apart; a
# template is found when this share of its words is covered.
LEAST = 3
GAP = 8
COVER = 0.6

# Everything but digits, letters and bytes over 127 parts words; A-Z become a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


class TokenAutomaton:
    """The smallest automaton of all runs of words of the templates.

    `step` goes through a text one word at a time and keeps the longest run that ends there
    and occurs in a template; `places` says in which templates, and where, a state's run ends.
    """

    def __init__(self, templates: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(templates):
            last = 0
            for at, w in enumerate(words):
                last = self._add(last, w)
                self.places[last].append((t, at + 1))
        # A state's run also ends wherever a longer one with it as ending does.
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            up = self.link[s]
            if up > 0:
                self.places[up] = sorted({*self.places[up], *self.places[s]})

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """A copy of q for the runs through p that are shorter than q's longest."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def step(self, state: int, length: int, w: bytes) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], length + 1
        return 0, 0


def _known_runs(data: bytes, known: frozenset[bytes], least: int, count: list[int]) -> Iterator[tuple[int, list[bytes]]]:
    """(position, words) of runs of template words, and the number of all words in `count`."""
    n, start, run = 0, 0, []
    for words in word_blocks(data, 0):
        for i in [i for i, w in enumerate(words) if w in known]:
            if run and i + n != start + len(run):
                if len(run) >= least:
                    yield start, run
                run = []
            if not run:
                start = i + n
            run.append(words[i])
        n += len(words)
    if len(run) >= least:
        yield start, run
    count[0] = n


class LicenceScanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.phrases = {tuple(p.encode().split()): label for p, label in phrases.items()}
        listed = list(dict.fromkeys([*templates, *((label, p) for p, label in phrases.items())]))
        self.labels = [label for label, _ in listed]
        words = [text.encode().split() for _, text in listed]
        self.sizes = [len(w) for w in words]
        self.required = [[self._place(w, run.encode().split()) for run in REQUIRED.get(text, ())]
                         for w, (_, text) in zip(words, listed)]
        self.automaton = TokenAutomaton(words)
        self.known = frozenset(w for t in words for w in t)

    @staticmethod
    def _place(words: list[bytes], run: list[bytes]) -> tuple[int, int]:
        at = next(i for i in range(len(words)) if words[i : i + len(run)] == run)
        return at, at + len(run)

    def _matches(self, start: int, run: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(state, end, length) of matches that the next word does not make longer."""
        state = length = 0
        for i, w in enumerate(run):
            new, longer = self.automaton.step(state, length, w)
            if length >= LEAST and longer != length + 1:
                yield state, start + i, length
            state, length = new, longer
        if length >= LEAST:
            yield state, start + len(run), length

    def scan(self, text: str | None) -> dict:
        """What one text holds; spans are (template, first word, word after the last, share covered)."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
        count = [0]
        places: dict[str, int] = {}
        n_base, first, last = 0, None, None
        # Per template the chains that a match may still join: (covered, template end, text start, text end, required runs met).
        open_: list[deque] = [deque() for _ in self.sizes]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for start, run in _known_runs(data, self.known, LEAST, count):
            for phrase, label in self.phrases.items():
                k = len(phrase)
                for i in range(len(run) - k + 1):
                    if run[i] == phrase[0] and tuple(run[i : i + k]) == phrase:
                        n_base += 1
                        places[label] = places.get(label, 0) + 1
                        at = start + i
                        first = at if first is None else min(first, at)
                        last = at if last is None else max(last, at)
            for state, end, length in self._matches(start, run):
                for t, t_end in self.automaton.places[state]:
                    chains = open_[t]
                    while chains and chains[0][3] < end - length - GAP:
                        chains.popleft()
                    covered, begin = length, end - length
                    own = sum(1 << k for k, (a, z) in enumerate(self.required[t]) if t_end - length <= a and z <= t_end)
                    met = own
                    for c, c_t, c_begin, c_end, c_met in chains:
                        if c_t <= t_end - length and c_end <= end - length and (
                                ((own | c_met).bit_count(), c + length) > (met.bit_count(), covered)):
                            covered, begin, met = c + length, c_begin, own | c_met
                    chains.append((covered, t_end, begin, end, met))
                    whole = met.bit_count() == len(self.required[t])
                    if whole and covered >= COVER * self.sizes[t] and best.get((t, begin), (0,))[0] < covered:
                        best[t, begin] = (covered, begin, end)
        spans = sorted((t, b, e, c / self.sizes[t]) for (t, _), (c, b, e) in best.items())
        base = sorted(places)
        labels = sorted({*base, *(self.labels[t] for t, *_ in spans)})
        return {
            "n_words": count[0], "n_base": n_base, "first_word": first, "last_word": last,
            "base_labels": ",".join(base), "labels": ",".join(labels),
            "score": max((c for *_, c in spans), default=0.0),
            "spans": [{"label": self.labels[t], "first": b, "after": e, "covered": c} for t, b, e, c in spans],
        }


_FIELDS = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([
        ("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("covered", pa.float64())]))),
])


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """Per document the licence phrases and the spans of licence templates in its whole text.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Base
    labels come from the places where a phrase's words follow each other. The method's own
    labels come from matches of at least LEAST words, chained in the order of a template
    with gaps up to GAP words, that cover at least COVER of its words and hold its required runs whole; `score` is the
    largest share covered, 0 if no template reached it. A text passes the automaton word
    by word in blocks, so its length does not matter. Null and empty texts have no words,
    no labels (empty strings) and null places. Rows with a null id and repeated rows keep
    their row; other columns are not read. An empty table gives no rows.
    """
    scanner = LicenceScanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = [scanner.scan(t) for t in part.column("_text").to_pylist()]
                cols = [pa.array([r[f.name] for r in rows], f.type) for f in _FIELDS]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", *_FIELDS.names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, first: long, after: long, covered: double>>",
    )
