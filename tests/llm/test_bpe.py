"""Byte-level BPE against the tiktoken library and against merges worked out one by one."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from conftest import CLASH
from reviewspark.llm import byte_bpe
from reviewspark.llm.byte_bpe import ByteBpe, PerfectHash, decode_ids, encode_texts
from reviewspark.llm.queries import op11_byte_bpe

ODD = ["", " ", "  \n\t  x", "it's THEY'LL we'd", "a" * 3000, "naïve été ΑΒΓ 漢字 \U0001f600‍", "12 345,67", "<|endoftext|>",
       "\x00\x1c\x85᠎  \xa0.", "  leading and trailing  ", "\r\n\r\n end", "x" + " " * 700 + "y", "é" * 800]


@pytest.fixture(scope="module")
def model():
    return ByteBpe.load()


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def texts_by_chance(seed, n=300):
    rng = random.Random(seed)
    parts = ["the", " of", "Éa", "\n", " ", "'s", "12", "zq", "ñandú", "漢", "\U0001f680", "...", "\t", "ction", "ZZZ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_like_the_library(model, library):
    for t in ODD + texts_by_chance(1):
        assert model.encode(t) == library.encode_ordinary(t)


def test_portions_and_forgetting(model, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TAKE", 7)
    monkeypatch.setattr(byte_bpe, "CACHE", 5)
    texts = ODD + texts_by_chance(2)
    got = model.encode_packed([None, *texts])
    assert got[0] == b""
    assert [np.frombuffer(x, "<u4").tolist() for x in got[1:]] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 4097])
def test_hash_is_perfect_and_minimal(n):
    hashes = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    if n:
        assert sorted(PerfectHash.build(hashes).slots(hashes).tolist()) == list(range(n))


def test_every_piece_of_the_vocabulary_is_one_lookup(model):
    assert sorted(model.table.slots(byte_bpe._hashes(model.keys)).tolist()) == list(range(len(model.ranks)))
    whole = [w for w in model.ranks if len(w) > 2][:500]
    known = [w.decode() for w in whole if w.isascii()]
    assert model.resolve(known) == [model.ranks[w.encode()].to_bytes(4, "little") for w in known]


def plain_merge(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges():
    rng = random.Random(5)
    words = [bytes([x]) for x in b"abcd"]
    while len(words) < 60:
        w = rng.choice(words) + rng.choice(words)
        if w not in words:
            words.append(w)
    small = ByteBpe.of({w: i for i, w in enumerate(words)}, r"\S+|\s+")
    for _ in range(500):
        data = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 40)))
        assert small.merge(data) == plain_merge(data, small.ranks)


def test_tables(spark, odd, none, model, library):
    rows = odd.withColumnRenamed("ids", "other")
    got = encode_texts(rows, model, keep=["lang"])
    assert got.columns == ["doc_id", "lang", "ids", "n_tokens"]
    want = sorted(((r.doc_id, r.lang, library.encode_ordinary(r.text or "")) for r in odd.collect()), key=repr)
    assert sorted(((r.doc_id, r.lang, list(r.ids)) for r in got.collect()), key=repr) == want
    back = decode_ids(got, model, keep=["n_tokens"])
    assert sorted((bytes(r.data) for r in back.collect())) == sorted((r.text or "").encode() for r in odd.collect())
    assert encode_texts(none, model).count() == 0 and decode_ids(encode_texts(none, model), model).count() == 0
    clash = encode_texts(odd, model, keep=[c for c in CLASH if c not in ("ids", "n_tokens")])
    assert clash.count() == odd.count()


def test_unknown_ids(spark, model):
    rows = spark.createDataFrame([(1, [0, 1]), (2, None), (3, []), (4, [50256]), (5, [-1]), (6, [None, 3]), (None, [5])],
                                 "doc_id long, ids array<int>")
    data = {r.doc_id: r.data for r in decode_ids(rows, model).collect()}
    by_id = {r: w for w, r in model.ranks.items()}
    assert bytes(data[1]) == by_id[0] + by_id[1] and bytes(data[None]) == by_id[5] and bytes(data[3]) == b""
    assert [data[i] for i in (2, 4, 5, 6)] == [None] * 4


def test_query(spark, tiny, con, library):
    got = {r.doc_id: r for r in op11_byte_bpe(spark, tiny).collect()}
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        r = got[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
