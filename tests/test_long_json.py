"""Nested files read as streams next to the same files parsed whole."""

import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from reviewspark.sources import long_json, raw_json
from reviewspark.sources.long_json import Broken, pieces


def product(rng, n):
    reviews = [{"language": rng.choice(["english", None]), "review": rng.choice(['a "quote" \\ {[', "}\n]é\U0001f600", "", "x" * 300]),
                "voted_up": rng.random() < 0.5, "votes_up": i, "author": {"steamid": str(i), "nested": [{"a": [1, {}]}]}} for i in range(n)]
    data = {"name": rng.choice(["N", 'data": {"review_stats": {"reviews": [', None]), "steam_appid": rng.randrange(99),
            "extra": {"deep": [1, 2, {"reviews": [{"review": "no"}]}]}, "review_stats": {"total_num_reviews": n, "reviews": reviews},
            "categories": [{"description": "c"}], "after": "kept"}
    if rng.random() < 0.2:
        del data["review_stats"]
    return {"success": rng.random() < 0.8, "data": data if rng.random() < 0.9 else None}


def documents(seed):
    rng = random.Random(seed)
    return [{str(rng.randrange(1000)): product(rng, rng.randrange(6)) for _ in range(rng.randrange(4))} for _ in range(5)]


@pytest.mark.parametrize("block, portion", [(1, 1), (7, 50), (64, 1000), (1 << 20, 300), (1 << 20, 1 << 20)])
@pytest.mark.parametrize("indent", [None, 2])
def test_pieces_of_a_stream(block, portion, indent):
    docs = documents(block)
    data = "\n".join(json.dumps(d, indent=indent, ensure_ascii=indent is None) for d in docs).encode()
    heads, lists = {}, {}
    for number, key, part, kind, text in pieces(io.BytesIO(data), block, portion):
        if kind == "head":
            heads[number] = key.decode(), json.loads(text)
        else:
            assert part == len(lists.get(number, []))
            lists.setdefault(number, []).append(json.loads(text))
    want = [(k, p) for d in docs for k, p in d.items()]
    assert sorted(heads) == list(range(len(want)))
    for number, (key, p) in enumerate(want):
        got_key, got = heads[number]
        stats = (p["data"] or {}).get("review_stats")
        reviews = stats["reviews"] if stats else []
        assert [r for part in lists.get(number, []) for r in part] == reviews
        if stats:
            p = json.loads(json.dumps(p))
            p["data"]["review_stats"]["reviews"] = []
        assert got_key == key and got == p


@pytest.mark.parametrize("text", ["<{}", "{", '{"a": {"b": "c}', "{]", '{"a": [}', "{} x", '"text"', "}", "{}{} 1"])
def test_broken_streams(text):
    with pytest.raises(Broken):
        list(pieces(io.BytesIO(text.encode()), 3))
    with pytest.raises(Broken):
        list(pieces(io.BytesIO(text.encode())))


def test_flat_table_is_the_same(spark, tmp_path):
    path = str(tmp_path / "in")
    os.makedirs(path)
    for i in range(6):
        with open(f"{path}/{i}.json", "w") as f:
            json.dump(documents(100 + i)[0] | documents(200 + i)[0], f)
    whole = raw_json.flatten(raw_json.products(raw_json.read_raw(spark, path)))
    with open(f"{path}/broken.json", "w") as f:
        f.write(json.dumps(documents(7)[0] | documents(8)[0]) + "oops")
    scanned = long_json.scan(spark, path)
    flat = raw_json.flatten(long_json.products(scanned))
    assert flat.columns == whole.columns and whole.count() > 5
    assert sorted(map(repr, flat.collect())) == sorted(map(repr, whole.collect()))
    assert [(os.path.basename(r.file), r.reason) for r in long_json.rejects(scanned).collect()] == [("broken.json", "text outside of a document")]
    extra = long_json.extra_attributes(scanned).filter("attribute = 'extra'").collect()
    assert extra and all(json.loads(r.value)["deep"][2] == {"reviews": [{"review": "no"}]} for r in extra)
    assert {r.attribute for r in long_json.extra_attributes(scanned).collect()} == {"extra", "after"}


def test_a_large_file_is_parsed_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "in")
    os.makedirs(path)
    reviews = [{"review": f"{i} " + "word " * 200, "voted_up": True} for i in range(9000)]
    with open(f"{path}/one.json", "w") as f:
        json.dump({"5": {"success": True, "data": {"name": "n", "steam_appid": 5, "review_stats": {"reviews": reviews}}}}, f)
    scanned = long_json.scan(spark, path)
    sizes = [r.n for r in scanned.filter("kind = 'reviews'").select(F.length("text").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * long_json.PORTION
    assert raw_json.flatten(long_json.products(scanned)).count() == 9000
