"""Operators 1, 7 and 10 against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewspark.llm import passages
from reviewspark.llm.components import components
from reviewspark.llm.line_dedup import dedup_lines
from reviewspark.llm.passages import compact_windows, matching_passages, repeated_passages, shingle_hashes
from reviewspark.llm.simhash_dedup import fingerprint_links, fingerprints_of, keep_one_each, simhash_components, tile_links


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    links += [(600, x) for x in range(601, 660)] + [(7, 7), (None, 3), (3, None), (1, 2), (2, 1)]
    want = roots({n for a, b in links if None not in (a, b) and a != b for n in (a, b)},
                 [x for x in links if None not in x])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.text(alphabet="ab XÉ\n\t\x0b\u00a0", max_size=40) | st.none(), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_fingerprints(texts):
    assert fingerprints_of(texts).tolist() == [plain_fingerprint(t) for t in texts]


def test_fingerprint_of_a_long_text():
    text = " ".join(f"w{i * i % 7919}" for i in range(3000))
    assert fingerprints_of([text])[0] == plain_fingerprint(text)


def test_tile_links_keep_what_is_connected():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 5).astype(np.uint64)
    x = np.unique([b ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for b in base for _ in range(60)])
    want = roots(x.tolist(), [(int(a), int(b)) for a in x for b in x if a < b and int(a ^ b).bit_count() <= 2])
    u, v = tile_links(x[: len(x) // 2], x[len(x) // 2 :], 2)
    for y in (x[: len(x) // 2], x[len(x) // 2 :]):
        a, b = tile_links(y, y, 2)
        u, v = np.concatenate([u, a]), np.concatenate([v, b])
    assert roots(x.tolist(), list(zip(u.tolist(), v.tolist()))) == want
    assert len(u) <= 4 * len(x)


def test_links_across_cells_and_tiles(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    x = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(8)} | {0, 2**64 - 1, 3}
    signed = [v - (1 << 64) if v >> 63 else v for v in x]
    df = spark.createDataFrame([(v,) for v in signed], "_fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in fingerprint_links(df, tile=4).collect()]
    assert all(a != b for a, b in links)
    assert roots(x, links) == roots(x, [(a, b) for a in x for b in x if a < b and (a ^ b).bit_count() <= 2])


def test_simhash_odd_rows(odd, none):
    got = simhash_components(odd).collect()
    rows = odd.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    fp = defaultdict(list)
    for r in rows:
        fp[r.doc_id].append(f"{plain_fingerprint(r.text):016x}")
    seen = defaultdict(list)
    for r in got:
        seen[r.doc_id].append(r.fingerprint)
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in fp.items()}
    blank = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in blank} == {2, 3, 4, None} and {r.component_id for r in blank} == {2}
    assert simhash_components(none).count() == 0


def test_one_of_each_group_stays(odd, none):
    kept = keep_one_each(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in kept.select("doc_id", "text").collect())
    assert [k[1] for k, _ in got] == [1, 1, 2, 5, 6, 7, 9, 0]
    assert keep_one_each(none).count() == 0


def plain_lines(docs):
    """docs: (id, text) in order; what is left of each text."""
    seen, out = set(), []
    for _, text in docs:
        lines = [] if text is None else text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append(text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_windows(spark):
    rng = random.Random(7)
    docs = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].text for i, _ in docs] == plain_lines(docs)
    assert all(r.n_lines == len(docs[i][1].split("\n")) for i, r in got.items())


def test_lines_odd_rows(odd, none):
    got = dedup_lines(odd)
    assert got.columns == [c for c in odd.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == odd.count()
    assert rows[7, "a\nb\nc\nd"].n_removed == 0 and rows[8, ""].n_removed == 4
    assert rows[2, None].n_lines == 0 and rows[3, ""].n_lines == 1
    assert any(k[0] == 5 and r.n_removed == 3 and r.n_lines == 5 for k, r in rows.items())
    assert dedup_lines(none).count() == 0


@given(st.integers(1, 60).flatmap(lambda n: st.permutations(range(n))), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_every_run_has_one_compact_window(order, length):
    f = np.array(order, np.uint64)
    c, a, z = compact_windows(f, length)
    for i in range(len(f)):
        for j in range(i + length - 1, len(f)):
            least = i + int(f[i : j + 1].argmin())
            assert [int(x) for x, y, w in zip(c, a, z) if y <= i <= x <= j <= w] == [least]


def test_shingle_hashes_do_not_depend_on_what_stands_around():
    h, of, word = shingle_hashes(["a b  c\nd E f", "", "x A b c d e"])
    assert h[0] == h[7] and (h[2:6] == 0).all() and of.tolist() == [0] * 6 + [2] * 6
    assert word.tolist() == [0, 1, 2, 3, 4, 5] * 2
    assert len(shingle_hashes(["", " "])[0]) == 0


def prose(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def planted(seed=8):
    """Documents with planted passages: exact, one word changed, in odd company, and too short."""
    rng = random.Random(seed)
    docs = {i: prose(rng, 120) for i in range(60)}
    exact, near, short = prose(rng, 60), prose(rng, 130), prose(rng, 30)
    for i in range(0, 12):
        docs[i][30:30] = exact
    for i in range(12, 20):
        copy = list(near)
        copy[20 + 3 * (i - 12)] = f"changed{i}"
        docs[i][10:10] = copy
    for i in range(20, 50):
        docs[i][5:5] = short
    docs[50] = list(docs[51])
    docs[52] = (["as"] * 70) + docs[52]
    docs[53] = docs[53] + (["as"] * 70)
    return {i: " ".join(w) for i, w in docs.items()}


def test_planted_passages(spark):
    docs = planted()
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert set(got) == {*range(20), 50, 51, 52, 53}
    assert {got[i].class_id for i in range(12)} == {0} and {got[i].class_id for i in range(12, 20)} == {12}
    assert got[51].class_id == 50 and got[53].class_id == 52
    assert any(s["first"] <= 30 and s["after"] >= 90 for s in got[3].passages)
    assert all(r.n_links >= 1 for r in got.values())


def test_rounds_find_what_the_first_partner_does_not_share(spark, monkeypatch):
    docs = planted(9)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = {(r.doc_id, r.class_id) for r in repeated_passages(df).collect()}
    monkeypatch.setattr(passages, "ROUNDS", 0)
    assert {(r.doc_id, r.class_id) for r in repeated_passages(df).collect()} == want


def test_matching_passages_measure():
    rng = random.Random(10)
    a = prose(rng, 80)
    b = list(a)
    b[40] = "other"

    def h(words):
        return shingle_hashes([" ".join(words)])[0][: len(words) - 4]

    assert matching_passages(h(a), h(b)) == [(0, 80, 0, 80, 71 / 81)]
    b[10] = b[25] = b[55] = "other"
    assert matching_passages(h(a), h(b)) == []
    assert matching_passages(h(a), h(a[:49])) == []
    assert matching_passages(h(a)[:0], h(a)) == []


def hashed(words):
    return shingle_hashes([" ".join(words)])[0][: max(0, len(words) - 4)]


def similar_span(x, y):
    """Whether some span of 46 shingles or more, at one place in both texts, is similar enough; by trying all."""
    return any(
        len(u & v) >= 0.8 * len(u | v)
        for a in range(len(x)) for z in range(a + 46, len(x) + 1) if x[a] == y[a] and x[z - 1] == y[z - 1]
        for u, v in [(set(x[a:z].tolist()), set(y[a:z].tolist()))])


def test_passages_inside_a_chain_that_is_changed_more():
    rng = random.Random(11)
    a = prose(rng, 160)
    b = list(a)
    for i in (12, 24, 35, 75, 98, 110, 121, 133, 146):
        b[i] = "other"
    x, y = hashed(a), hashed(b)
    found = matching_passages(x, y)
    assert found and all(s >= 0.8 and z - i >= 50 for i, z, *_, s in found)
    n = [0, 0]
    for _ in range(40):
        b = list(a[:110])
        for i in range(110):
            if rng.random() < (0.12 if i < 40 else 0.03):
                b[i] = f"other{i}"
        want = similar_span(hashed(a[:110]), hashed(b))
        n[want] += 1
        assert bool(matching_passages(hashed(a[:110]), hashed(b))) == want
    assert min(n) > 3


def test_passages_whose_words_also_stand_elsewhere():
    rng = random.Random(12)
    p = prose(rng, 60)
    for early in (5, 15, 25):
        for n in (50, 60):
            a = hashed(prose(rng, 30) + p[:n] + prose(rng, 30))
            b = hashed(prose(rng, 20) + p[:early] + prose(rng, 25) + p[:n] + prose(rng, 10))
            for x, y in ((a, b), (b, a)):
                assert any(z - i >= n and e - c >= n and s == 1 for i, z, c, e, s in matching_passages(x, y)), (early, n)
    line = prose(rng, 7)
    a, b = line * 4 + p + line * 9, line * 20 + p[:30] + line + p[:30] + p[30:] + line * 3
    assert any(z - i >= 60 and i <= 28 and s >= 0.8 for i, z, _, _, s in matching_passages(hashed(a), hashed(b)))
    many = hashed(["as"] * 3000 + p)
    assert matching_passages(many, hashed(["as"] * 2000 + p))[0][4] == 1


def test_repeats_of_a_line_do_not_meet_all_repeats_of_the_other_text():
    rng = random.Random(16)
    for line in (["as"], prose(rng, 7)):
        a = prose(rng, 40) + line * (840 // len(line)) + prose(rng, 40)
        b = prose(rng, 20) + line * (126 // len(line)) + prose(rng, 60)
        found = matching_passages(hashed(a), hashed(b))
        assert 0 < len(found) < 40
        assert set().union(*(range(i, z) for i, z, *_ in found)) == set(range(40, 880))
        assert set().union(*(range(c, e) for _, _, c, e, _ in found)) == set(range(20, 146))


def test_a_word_repeated_very_often_is_one_place():
    def folded(*parts):
        return [w for word, n in parts for w in [word] * n]

    a = folded(("as", 900), ("so", 70), ("as", 400), ("to", 1500), ("so", 300))
    b = folded(("as", 300), ("so", 900), ("as", 800), ("to", 100), ("so", 1200))
    found = matching_passages(hashed(a), hashed(b))
    assert 0 < len(found) < 10 and all(s == 1 for *_, s in found)
    assert set().union(*(range(i, z) for i, z, *_ in found)) == set(range(len(a)))
    assert set().union(*(range(c, e) for _, _, c, e, _ in found)) == set(range(len(b)))
    assert matching_passages(hashed(["as"] * 900), hashed(["as"] * 45)) == []


def test_places_without_room_lie_in_no_passage():
    rng = random.Random(17)
    n = [0, 0]
    for k in range(60):
        a, p = prose(rng, 300), prose(rng, 70)
        b = prose(rng, 200)
        q = [w if rng.random() > 0.02 * (k % 4) else "other" for w in p]
        a[100:100], b[60:60] = p + p[:20], p[:20] + q
        x, y = hashed(a), hashed(b)
        pair = passages._Pair(x, y, 0.8)
        want = similar_span(x[100:166], y[80:146])
        n[want] += 1
        if want:
            i, z, c, e, _ = max(matching_passages(x, y), key=lambda m: m[1] - m[0])
            assert pair.room[0][i : z - 4].all() and pair.room[1][c : e - 4].all()
        assert not pair.room[0].any() or not (pair.room[0][220:].any() or pair.room[1][190:].any())
        assert not want or passages._may_match(np.unique(x), [y[:70], y]).tolist()[1]
        assert not passages._may_match(np.unique(x), [y[190:], y[:0]]).any()
    assert min(n) > 3


def test_last_step_links_copies_with_a_block_put_in(spark, monkeypatch):
    rng = random.Random(15)
    docs = {}
    for k in range(3, 11):
        p = prose(rng, 80)
        docs[2 * k] = prose(rng, 40) + p + prose(rng, 40)
        docs[2 * k + 1] = prose(rng, 25) + p[:40] + prose(rng, k) + p[40:] + prose(rng, 25)
    monkeypatch.setattr(passages, "ROUNDS", 0)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in repeated_passages(df).collect()}
    assert got == {i: i - i % 2 for i in docs}


def test_passages_odd_rows(odd, none, spark):
    got = repeated_passages(odd.unionByName(odd.withColumn("doc_id", odd.doc_id + 100)))
    assert {(r.doc_id, r.class_id, r.n_links) for r in got.collect()} == {(5, 5, 1), (105, 5, 1)}
    assert repeated_passages(odd).count() == 0
    assert repeated_passages(none).count() == 0


def test_the_two_line_hashes_are_independent(spark):
    from reviewspark.llm.line_dedup import two_hashes

    r = spark.createDataFrame([("some line",)], "t string").select(*two_hashes(F.col("t")), F.expr("xxhash64(7)").alias("seed")).first()
    # The second starts from the hash of a constant, not from the first.
    assert r.x == xxhash.xxh64_intdigest(b"some line", 42) - (1 << 64) * (xxhash.xxh64_intdigest(b"some line", 42) >> 63)
    again = xxhash.xxh64_intdigest(b"some line", r.seed % 2**64)
    assert r.y == again - (1 << 64) * (again >> 63)


def test_of_rows_equal_in_id_and_text_the_same_one_stays(spark):
    rows = [(1, "same text here", "b"), (1, "same text here", "a"), (1, "same text here", "a"), (2, "same text here", "c"), (None, None, "d"), (None, None, "e")]
    kept = set()
    for shuffle in range(4):
        mixed = random.Random(shuffle).sample(rows, len(rows))
        df = spark.createDataFrame(mixed, "doc_id long, text string, source string").repartition(shuffle + 1)
        kept.add(frozenset(map(tuple, keep_one_each(df).collect())))
    assert len(kept) == 1
    (one,) = kept
    assert sorted((i or 0) for i, _, _ in one) == [0, 1]
