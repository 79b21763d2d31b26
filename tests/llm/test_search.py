"""Operators 2, 3 and 4 against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reviewspark.llm.decontaminate import benchmark_hits, drop_contaminated, fingerprint, shingles, words
from reviewspark.llm.queries import URL_RULES
from reviewspark.llm.topk import block_topk, exact_topk
from reviewspark.llm.url_filter import bloom_blocks, filter_urls


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1", "https://example.com/en/2?x", "https://a.example.com/en", "ftp://x.net/es/",
            "http://net/es/q", "http://xnet/es/q", "http://É.net/fr/#a", "no scheme", None, "", "://", "://h?x=/y",
            "http://example.org/a/", "https://example.org/a?b", "http://example.org/A", "http://x.org://y/z", "x://com/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], "again"), (None, urls[12], "z")],
                                  "page_id long, url string, host string")
    listed = spark.createDataFrame([("gopher://EXAMPLE.org/a//",), (None,), ("nothing",), ("http://example.org/a",)], "url string")
    got = filter_urls(pages, listed, URL_RULES).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path = plain_url(urls[r.page_id if r.page_id is not None else 12])
        fits = [(len(t), w, t) for w, t in URL_RULES
                if (host == t[: t.index("/")] or host.endswith("." + t[: t.index("/")])) and path.startswith(t[t.index("/") :])]
        best = max(fits, default=None)
        on_list = best is None and host + path.rstrip("/") == "example.org/a"
        assert (r.host, r.path, r.rule, r.listed) == (host, path, best and best[2], on_list)
        assert r.verdict == (best[1] if best else "block" if on_list else "allow")
    assert {r.verdict for r in filter_urls(pages, listed.filter("false"), URL_RULES).filter("rule is null").collect()} == {"allow"}
    assert filter_urls(pages.filter("false"), listed, URL_RULES).count() == 0


def test_bloom_passes_every_key(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    assert bloom_blocks(keys, "k", 750).agg(F.sum(F.bit_count("_word"))).first()[0] <= 3000 * 5


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def weighted(a, b):
    a, b = (Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_planted_items(spark, odd, none):
    rng = random.Random(11)

    def prose(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]

    items = {i: prose(rng.randrange(14, 60)) for i in range(30)}
    items[30] = items[0]
    docs = {}
    for d in range(80):
        w = prose(100)
        if d % 2:
            put = list(items[d % 30])
            for _ in range(d % 5):
                put[rng.randrange(len(put))] = "other"
            if d % 7 == 0:
                put.insert(len(put) // 2, "inserted")
            w[d % 50 : d % 50] = put
        docs[d] = w
    docs[80] = items[3] + items[4]
    docs[81] = items[5][:-1]
    df = spark.createDataFrame([(d, ", ".join(w).title()) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(40, None), (41, ""), (42, "too few words")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in benchmark_hits(df, bench).collect()}
    want = {}
    for d, w in docs.items():
        for i, item in items.items():
            best = max((weighted(w[max(0, s) : s + len(item)], item) for s in range(-len(item), len(w))), default=0)
            if best >= 0.8:
                want[d, i] = best
    assert {k: r.similarity for k, r in got.items()} == want
    clean = drop_contaminated(df, bench)
    assert {r.doc_id for r in clean.collect()} == set(docs) - {d for d, _ in want}
    assert benchmark_hits(odd, bench).count() == 0 and drop_contaminated(odd, bench).count() == odd.count()
    assert drop_contaminated(odd, bench).columns == odd.columns
    assert benchmark_hits(none, bench).count() == 0 and benchmark_hits(df, bench.filter("false")).count() == 0
    found = benchmark_hits(odd, spark.createDataFrame([(1, "no number here at all"), (2, "The Quick brown fox jumps")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(None, 1), (1, 2)}


def test_native_fingerprint(spark):
    df = spark.createDataFrame([("one two three four five six seven eight",)], "t string")
    r = df.select(words(F.col("t")).alias("w")).select(shingles(F.col("w")).alias("h"))
    r = r.select("h", fingerprint(F.col("h")).alias("f")).first()
    assert len(r.h) == 4
    assert r.f % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h % 2**64 >> b & 1 for h in r.h) > 4)


def plain_topk(rows, k):
    out = []
    good = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in set(good):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good if c != q and len(w) == len(v))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_topk(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(19)]) for i in range(700)]
    rows += [(700 + i, rows[i % 5][1]) for i in range(40)]
    rows += [(1000, None), (1001, [None] + [1.0] * 18), (1100, [float("nan")] * 19), (1200, [float("inf")] * 19), (None, [1.0] * 19),
             (1300, [1.0, 2.0]), (1301, [3.0, -1.0]), (1400, []), (1401, []), rows[0], rows[200], *[rows[7]] * 15, rows[9], rows[9], (1500, [0.0] * 19)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    for k, block in ((10, 64), (3, 5)):
        got = exact_topk(df, df.filter("vec_id % 100 = 0"), k=k, candidates=block, block=3)
        assert sorted(tuple(r) for r in got.collect()) == plain_topk(rows, k)
    assert exact_topk(df, df.filter("false")).count() == 0
    assert exact_topk(df.filter("false"), df.filter("vec_id % 100 = 0")).count() == 0


def test_large_components_stay_exact():
    q = np.array([[2**30, 3]], np.int64)
    c = np.array([[2**30, 2**30], [5, 4]], np.int64)
    found = block_topk(q, np.array([9]), c, np.array([1, 2]), 1, {}, np.array([0]))
    assert found == [(9, 0, 1, 2**60 + 15)]


def test_urls_where_the_filter_outgrows_a_broadcast(spark, monkeypatch):
    from reviewspark.llm import url_filter

    urls = [f"http://{h}/{p}" for h in ("a.com", "b.net", "c.org") for p in ("", "es/1", "fr/2", "x")] + [None, "", "http://c.org/x"]
    pages = spark.createDataFrame([(i if i % 3 else None, u) for i, u in enumerate(urls * 3)], "page_id long, url string")
    listed = spark.createDataFrame([("http://c.org/x",), ("http://b.net/x",)], "url string")
    want = sorted(map(repr, filter_urls(pages, listed, URL_RULES).collect()))
    monkeypatch.setattr(url_filter, "broadcast_if_small", lambda df, size: df)
    assert sorted(map(repr, filter_urls(pages, listed, URL_RULES).collect())) == want and len(want) == len(urls) * 3
