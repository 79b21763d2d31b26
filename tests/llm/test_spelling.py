"""Spelling variants against every pair of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reviewspark.llm.queries import lost_letter
from reviewspark.llm.spelling import count_words, near_words, pivots, spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=5):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def words_by_chance(seed, letters, n=250, least=4, most=9):
    rng = random.Random(seed)
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
        if words and rng.random() < 0.7:
            w = rng.choice(list(words))
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
        if len(w) >= least:
            words[w] = int(5 ** (rng.random() * 6))
    return words


def table(spark, words):
    return spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n long, form string, last int")


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé\U0001f600漢ÿ"])
def test_all_pairs(spark, letters):
    for seed in range(2):
        words = words_by_chance(seed, letters)
        pairs = {(r.word, r.near) for r in near_words(table(spark, words)).collect()}
        assert pairs == {(a, b) for a in words for b in words if one_edit(a, b)}
        assert sorted(tuple(r) for r in spelling_variants(table(spark, words)).collect()) == plain(words)


def test_long_way_to_the_root(spark):
    words = {"abcdef"[:6] + "x" * i: 5**i for i in range(12)}
    got = {r.word: r.root for r in spelling_variants(table(spark, words)).collect()}
    assert set(got.values()) == {"abcdef" + "x" * 11}


def test_odd_words(spark):
    rows = [("letter", 2), ("letter", 3), (None, 9), ("lettre", None), ("letters", 25), ("abc", 9), ("", 4), ("z" * 3000, 1),
            ("z" * 2999, 5), ("Letter", 25)]
    got = {r.word: tuple(r)[1:] for r in spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"letter": ("Letter", "Letter", 5, 2, 25), "letters": (None, "letters", 25, 1, None),
                   "Letter": (None, "Letter", 25, 1, None), "z" * 3000: ("z" * 2999, "z" * 2999, 1, 1, 5),
                   "z" * 2999: (None, "z" * 2999, 5, 1, None)}
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame(rows, "word string, n long"), ratio=1)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(3)
    cost = rng.integers(1, 9, (300, 8))
    member = rng.random((300, 8)) < 0.5
    member[:, [0, 4]] = True
    first, second = pivots(cost, member)
    for c, m, i, j in zip(cost, member, first, second):
        best = min(c[a] + c[b] for a in range(8) for b in range(a + 2, 8) if m[a] and m[b])
        assert j >= i + 2 and m[i] and m[j] and c[i] + c[j] == best


def plain_counts(rows, least_length, least_count):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def test_counts(spark, odd, none):
    rng = random.Random(8)
    stock = ["Überall", "überall", "ÀÉÎabc", "straße", "wordword", "x×y÷zabcd", "short", "naïvely", "exactly", "ﬁnally"]
    rows = [(rng.choice([None, i % 90]), rng.choice([None, "", " ".join(rng.choice(stock) for _ in range(40))])) for i in range(400)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in count_words(docs, edit=lost_letter).collect()}
    assert got == plain_counts(rows, 6, 5) and len(got) > 8
    long = [(r.doc_id, r.text) for r in odd.collect()]
    assert {r.word: r.n for r in count_words(odd, edit=lost_letter).collect()} == plain_counts(long, 6, 5)
    assert count_words(none).count() == 0
