"""Operators 5, 6, 8 and 9 against brute force, round trips and held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewspark.llm.language_cnn import (
    BATCH, WIDTHS, WINDOW, ByteNetwork, byte_windows, fit_languages, identify_languages, keep_known, predict,
)
from reviewspark.llm.license_scan import PHRASES, TEMPLATES, LicenceScanner, TokenAutomaton, scan_licences
from reviewspark.llm.pieces import PieceModel, decode_ids, encode_texts
from reviewspark.llm.queries import QUERIES
from reviewspark.llm.toxicity import fit_toxicity, marked, score_toxicity, windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_places(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return w, sorted(found)


def licence_texts():
    rng = random.Random(13)
    texts = [None, "", "Under the MIT-License!", "CC-BY-NC cc by nc", "apache license, version 2 under the mit license",
             "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
             "é under the mit licenseé", "licensed under the", "cc by\x00nc", "under the mit\nlicense " * 3000]
    vocabulary = [*"under the mit license apache version 2 0 cc by nc licensed gnu".split(), "x", "É", "."]
    return texts + [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(60)]


def test_licence_places(spark):
    texts = licence_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in scan_licences(df).collect()}
    for i, t in enumerate(texts):
        w, found = plain_places(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        base = {label for _, label in found}
        assert r.base_labels == ",".join(sorted(base))
        assert base <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[6].labels == "gpl-3" and got[6].base_labels == "" and got[6].score == 1
    assert got[8].labels == "" and got[8].score == 0
    assert got[5].spans[0]["label"] == "apache-2"


def test_matching_statistics():
    templates = [t.encode().split() for _, t in TEMPLATES] + [b"a b a b a".split(), b"b a b b".split()]
    auto = TokenAutomaton(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    ends = {}
    for n, t in enumerate(templates):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                ends.setdefault(tuple(t[i:j]), set()).add((n, j))
    rng = random.Random(14)
    vocabulary = sorted({w for t in templates for w in t}) + [b"a", b"b"] * 20
    text = [rng.choice(vocabulary) for _ in range(1500)] + [w for t in templates for w in t]
    state = length = 0
    for i, w in enumerate(text):
        state, length = auto.step(state, length, w)
        want = next((k for k in range(min(i + 1, 40), 0, -1) if tuple(text[i + 1 - k : i + 1]) in runs), 0)
        assert length == want
        if length:
            assert set(auto.places[state]) == ends[tuple(text[i + 1 - length : i + 1])]


def test_templates_are_found_with_gaps():
    scanner = LicenceScanner(TEMPLATES, PHRASES)
    words = dict(TEMPLATES[::-1])["bsd"].split()
    r = scanner.scan("x " * 5 + " ".join(words[:8]) + " new words " + " ".join(words[8:]))
    assert r["labels"] == "bsd" and r["score"] == 1 and r["spans"] == [{"label": "bsd", "first": 5, "after": 7 + len(words), "covered": 1.0}]
    assert scanner.scan(" ".join(words[:8]))["labels"] == ""


def test_notices_and_headings_of_common_licences():
    gnu = """This program is free software: you can redistribute it and/or modify
 * it under the terms of the {} as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version."""
    cases = {
        "gpl-3": [gnu.format("GNU General Public License", 3), "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007",
                  "Licensed under the GNU General Public License Version 3"],
        "gpl-2": [gnu.format("GNU General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
        "lgpl-2.1": [gnu.format("GNU Lesser General Public License", "2.1")],
        "lgpl-3": [gnu.format("GNU Lesser General Public License", 3)],
        "agpl-3": [gnu.format("GNU Affero General Public License", 3)],
        "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL "
                  "was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."],
        "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
        "mit": ["The above copyright notice and this permission notice shall be included in all\ncopies or substantial "
                "portions of the Software."],
        "bsd": ["1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                "following disclaimer."],
        "apache-2": ["Unless required by applicable law or agreed to in writing, software distributed under the License is "
                     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
        "unlicense": ["This is free and unencumbered software released into the public domain."],
        "cc0": ["CC0 1.0 Universal"],
        "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
        "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
        "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
        "": ["GNU General Public License, Version 2.0, the GNU Lesser General Public License, Version 2.1, the GNU Affero "
             "General Public License, Version 3.0, or any later versions of those licenses.",
             "You should have received a copy of the license; the software is free and public."],
    }
    scanner = LicenceScanner(TEMPLATES, PHRASES)
    got = {t: scanner.scan("Copyright 2020 A. Person\n" + t + "\nint main;")["labels"] for ts in cases.values() for t in ts}
    assert got == {t: label for label, ts in cases.items() for t in ts}


def test_licences_odd_rows(odd, none):
    got = scan_licences(odd).collect()
    assert len(got) == odd.count() and all(r.labels == "" for r in got)
    assert {r.n_words for r in got if r.doc_id == 5} == {120_004}
    assert scan_licences(none).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return PieceModel.load()


def plain_viterbi(m, text):
    known = {m.content[i]: i for i in range(len(m.content)) if m.content[i] and i not in set(m.byte_ids)}
    s = " " + text
    best = [(0.0, 0, -1)] + [(-float("inf"), 0, -1)] * len(s)
    for i in range(len(s)):
        own = False
        for j in range(i + 1, min(len(s), i + m.longest) + 1):
            v = known.get(s[i:j].encode())
            if v is not None:
                own |= j == i + 1
                if best[i][0] + m.scores[v] > best[j][0]:
                    best[j] = (best[i][0] + m.scores[v], i, v)
        if not own and best[i][0] + m.unknown > best[i + 1][0]:
            best[i + 1] = (best[i][0] + m.unknown, i, -1)
    out, j = [], len(s)
    while j:
        _, i, v = best[j]
        out[:0] = [v] if v >= 0 else [m.byte_ids[b] for b in s[i:j].encode()]
        j = i
    return out


def test_pieces(pieces):
    rng = random.Random(15)
    texts = ["a" * 100, "▁x ▁", "  two  spaces ", "\n\n a\n", "日本語 漢字", "\U0001f600 \x00", "x" * 70 + "é" * 40, "\t tab", "###***"]
    texts += ["".join(rng.choice("ab é\n▁ 漢\U0001f600the ing") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    ids = pieces.encode_many(texts)
    for t, got in zip(texts, ids):
        assert got == plain_viterbi(pieces, t)
        assert got == list(pieces._viterbi((" " + t).encode())), "both forms agree"
        assert pieces.decode(got) == t
    assert pieces.encode_many([None, ""]) == [None, []]


def test_pieces_odd_rows(odd, none, pieces):
    enc = encode_texts(odd, pieces, keep=["lang"])
    rows = enc.collect()
    assert len(rows) == odd.count()
    assert all(r.round_trip for r in rows if r.ids is not None) and sum(r.ids is None for r in rows) == 2
    back = decode_ids(enc, pieces).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((r.doc_id, r.text)) for r in odd.collect())
    assert encode_texts(none, pieces).count() == 0


def test_gradients_of_the_network():
    rng = np.random.default_rng(16)
    net = ByteNetwork.fresh(["a", "b", "c"])
    net.params = [p.astype(np.float64) for p in net.params]
    x, y = rng.integers(97, 123, (5, 30)), np.array([0, 1, 2, 1, 0])

    def loss():
        return -np.log(net.chances(x)[np.arange(5), y]).mean()

    for p, g in zip(net.params, net.gradients(x, y)):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape) if p is not net.params[0] else (int(x[0, 3]), int(rng.integers(p.shape[1])))
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_windows_hold_whole_texts():
    x, of, held = byte_windows(["a" * 500, "é", "b" * 192])
    assert of.tolist() == [0, 0, 0, 1, 2] and held.tolist() == [192, 192, 116, 2, 192]
    assert x.astype(bool).sum() == 500 + 2 + 192
    text = "some words and " * 40 + "x" * 500
    assert b"".join(w[:-1] for w in windows(text.encode())) == text.encode()
    assert all(len(w) <= 97 for w in windows(text.encode()))
    assert marked(" Stupid\nWORTHLESS ") == b"stupid worthl|ess"


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_language_cnn"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n >= 0.95


def test_languages_odd_rows(odd, none):
    model = fit_languages(odd)
    got = identify_languages(odd, model).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 4, 6, None}
    assert all(r.score == 0 for r in got if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in got)
    kept = keep_known(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 5, 7, 8, 9, None}
    assert identify_languages(none, model).count() == 0 and keep_known(none, model).count() == 0
    assert predict(fit_languages(none), ["text"]) == [("und", 0.0)]


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    bad = got.toxic == 1
    assert ((got.predicted == 1) & bad).sum() / bad.sum() >= 0.75
    assert ((got.predicted == 1) & ~bad).sum() / (~bad).sum() <= 0.03
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (9, 1), (3, 1), (None, 1), (6, None), (8, 7)], "doc_id long, toxic int")
    model = fit_toxicity(odd, labels)
    got = score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert fit_toxicity(odd, labels.filter("false")) is None and fit_toxicity(none, labels) is None
    assert {r.score for r in score_toxicity(odd, None).collect()} == {0.0}
    assert score_toxicity(none, model).count() == 0


def test_forward_pass_byte_by_byte():
    rng = np.random.default_rng(9)
    net = ByteNetwork.fresh(["de", "en", "fr"])
    net.params = [rng.normal(size=p.shape) for p in net.params]
    texts = ["Ein Satz mit Umlauten: äöü. " * 9, "short", "é", "", None, "12 34", "x" * 193]

    def window(data):
        data = data + bytes(WINDOW - len(data))
        seen = [net.params[0][b] for b in data]
        hidden = []
        for i, w in enumerate(WIDTHS):
            weight, bias = net.params[1 + 2 * i : 3 + 2 * i]
            for f in range(weight.shape[1]):
                answers = [float(np.concatenate(seen[at : at + w]) @ weight[:, f]) for at in range(WINDOW - w + 1)]
                hidden.append(max(max(answers) + bias[f], 0.0))
        e = np.exp(np.array(hidden) @ net.params[-2] + net.params[-1])
        return e / e.sum()

    for text, (lang, score) in zip(texts, predict(net, texts)):
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0.0)
            continue
        data = text.encode()
        parts = [data[at : at + WINDOW] for at in range(0, len(data), WINDOW)]
        mean = sum(window(p) * len(p) for p in parts) / len(data)
        assert lang == net.languages[int(mean.argmax())] and abs(score - mean.max()) < 1e-9
