"""Density topics and components against plain loops."""

import math
import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from reviewspark.operators.components import components
from reviewspark.operators.density import density_topics, least_size_by_volume, signed_sums, signed_words


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(200)],
    [(i, i + 1) for i in range(200, 0, -2)] + [(7, 7), (None, 3), (4, None), (1, 2), (2, 1)],
    [(0, i) for i in range(1, 300)],
    [(random.Random(i).randrange(400), random.Random(-i).randrange(400)) for i in range(330)],
    [],
])
def test_components(spark, pairs):
    df = spark.createDataFrame([(*p, "x") for p in pairs], "a long, b long, component string")
    assert {r.node: r.component for r in components(df).collect()} == plain_components(pairs)


def test_components_of_names(spark):
    pairs = [("b", "c"), ("z", "y"), ("c", "a")]
    found = components(spark.createDataFrame(pairs, "a string, b string"))
    assert {(r.node, r.component) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")}


def plain_topics(rows, dims, side, least_density, least_size):
    """{row number: topic} of one product; rows are coordinates or None."""
    cells = {i: tuple(math.floor(x / side) for x in c) for i, c in enumerate(rows) if c is not None and len(c) == dims}
    mass = Counter(cells.values())
    steps = list(product((-1, 0, 1), repeat=dims))
    touch = {c: [n for s in steps if (n := tuple(map(sum, zip(c, s)))) in mass] for c in mass}
    density = {c: sum(mass[n] for n in touch[c]) for c in mass}
    top = {c: (density[c] // least_density).bit_length() - 1 for c in mass}
    branch = {}
    for level in range(max(top.values(), default=-1) + 1):
        here = [c for c in mass if top[c] >= level]
        found = plain_components([(a, b) for a in here for b in touch[a] if top[b] >= level])
        branch.update({(level, c): found.get(c, c) for c in here})
    size = Counter()
    for (level, c), b in branch.items():
        size[level, b] += mass[c]
    alive = {n for n in size if size[n] >= least_size}
    up = {n: (n[0] - 1, branch[n[0] - 1, n[1]]) if n[0] else None for n in alive}
    children = defaultdict(list)
    for n in alive:
        children[up[n]].append(n)
    head = {}
    for n in sorted(alive):
        head[n] = n if up[n] is None or len(children[up[n]]) > 1 else head[up[n]]
    gain = Counter()
    for n in alive:
        gain[head[n]] += size[n]
    inside = defaultdict(list)
    for h in gain:
        if up[h] is not None:
            inside[head[up[h]]].append(h)

    def best(h):
        below = [best(x) for x in inside[h]]
        total = sum(b for b, _ in below)
        return (gain[h], [h]) if gain[h] >= total else (total, [x for _, xs in below for x in xs])

    kept = {x for h in gain if up[h] is None for x in best(h)[1]}
    cluster = {}
    for (level, c), b in sorted(branch.items()):
        if (level, b) in alive and head[level, b] in kept:
            cluster.setdefault(c, head[level, b])
    joined = dict(cluster)
    for c in mass:
        near = [(sum((x - y) ** 2 for x, y in zip(c, n)), -density[n], cluster[n]) for n in touch[c] if n in cluster]
        if c not in cluster and near:
            joined[c] = min(near)[2]
    sizes = Counter()
    for c, k in joined.items():
        sizes[k] += mass[c]
    number = {k: i for i, (k, _) in enumerate(sorted(sizes.items(), key=lambda x: (-x[1], x[0])))}
    return {i: number[joined[cells[i]]] if i in cells and cells[i] in joined else -1 for i in range(len(rows))}


def blobs(seed, dims, n):
    rng = random.Random(seed)
    middles = [[rng.uniform(-40, 40) for _ in range(dims)] for _ in range(5)]
    rows = [[round(rng.gauss(m, rng.choice([1, 3, 8]))) for m in rng.choice(middles)] for _ in range(n)]
    return rows + [[round(rng.uniform(-60, 60)) for _ in range(dims)] for _ in range(n // 5)] + [[0] * dims] * 30 + [None, [1]]


@pytest.mark.parametrize("dims, side, least_density, least_size", [(2, 3, 6, 15), (3, 4, 5, 10), (1, 1, 4, 8), (2, 5, 1000, 5)])
def test_all_products_at_once(spark, dims, side, least_density, least_size):
    groups = {(1, "a"): blobs(1, dims, 400), (1, None): blobs(2, dims, 150), (None, "a"): blobs(3, dims, 300), (2, "z"): [[9] * dims]}
    rows = [(*k, i, c) for k, v in groups.items() for i, c in enumerate(v)]
    df = spark.createDataFrame(rows, "app_id int, side string, id long, at array<long>").repartition(5)
    got = density_topics(df, "id", "at", ["app_id", "side"], dims, side, least_density, F.lit(least_size)).collect()
    want = {(*k, i): t for k, v in groups.items() for i, t in plain_topics(v, dims, side, least_density, least_size).items()}
    assert {(r.app_id, r.side, r.id): r.topic for r in got} == want and len(got) == len(rows)
    assert least_density > 100 or len(set(want.values())) > 2


def test_without_keys_and_least_size_by_volume(spark):
    rows = blobs(7, 2, 500)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "id long, at array<long>")
    usable = sum(c is not None and len(c) == 2 for c in rows)
    for large, least in ((usable, 20), (usable - 1, 100)):
        got = density_topics(df, "id", "at", [], 2, 3, 6, least_size_by_volume(large=large))
        assert {r.id: r.topic for r in got.collect()} == plain_topics(rows, 2, 3, 6, least)
    assert density_topics(df.filter("false"), "id", "at", [], 2, 3, 6, F.lit(5)).count() == 0


def test_signed_sums(spark):
    rng = random.Random(4)
    rows = [[rng.uniform(-3, 3) for _ in range(n)] for n in (1, 8, 64, 70)] + [[None, 1.0], [float("nan")], [float("inf")], None, []]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<double>")
    for r in df.select("i", signed_sums(F.col("v"), 3, 100).alias("s")).collect():
        v = rows[r.i]
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            assert r.s is None
        else:
            assert r.s == [sum((-1) ** (i & j).bit_count() * math.floor(x * 100) for i, x in enumerate(v)) for j in (1, 2, 3)]


def test_points_are_placed_once(spark):
    """The words of a text are read for its cell, and not a second time for its topic."""
    docs = spark.createDataFrame([(i, f"left right {i % 3}") for i in range(60)], "id long, t string")
    points = docs.select("id", signed_words(F.split("t", " "), 3).alias("at"))
    found = density_topics(points, "id", "at", [], 3, 350, 16, F.lit(20))
    plan = found._jdf.queryExecution().toString()
    assert "signed_words" not in plan and "EvalPython" not in plan and "split(" not in plan
    assert found.count() == 60
