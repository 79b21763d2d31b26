"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from reviewspark.llm.centroids import add_changes, centroid_clusters, changed, nearest

KIND = "vec_id long, embedding array<float>, cluster int, distance string, _v int, _dots string"


def plain(rows, k, rounds, dims, scale):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    by = lambda r: ("g" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=by)[:k]]
    for i in range(rounds + 1):
        placed = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
        if i < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, at) in zip(kept, placed) if at == j]
                if own:
                    centres[j] = tuple(sum(x) // len(own) for x in zip(*own))
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, placed)), key=repr), centres


def rows_by_chance(n, dims, seed, wide=2.0):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.015625, wide * rng.random()]) for _ in range(dims)]) for i in range(n)]
    return rows + rows[:5] + [(3, rows[-1][1]), (None, rows[1][1]), (None, rows[2][1])] + [
        (900, None), (901, rows[0][1][:-1]), (902, [None, *rows[0][1][1:]]), (903, [float("nan"), *rows[0][1][1:]]),
        (904, [float("inf"), *rows[0][1][1:]]), (905, [])]


@pytest.mark.parametrize("n, k, rounds, dims, wide", [(60, 4, 3, 3, 2.0), (40, 16, 2, 5, 900.0), (7, 16, 3, 2, 1.0), (30, 3, 0, 4, 1.0)])
def test_plain_integers(spark, n, k, rounds, dims, wide):
    rows = rows_by_chance(n, dims, n, wide)
    df = spark.createDataFrame([(*r, 7, "x", 1, None) for r in rows], KIND)
    found = centroid_clusters(df, k, rounds, dims, scale=64)
    want, centres = plain(rows, k, rounds, dims, 64)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.members.collect()), key=repr) == want
    table = {r.cluster: r for r in found.centroids.collect()}
    assert [tuple(table[j].centroid) for j in range(len(centres))] == centres
    for j, r in table.items():
        own = [d for _, c, d in want if c == j]
        assert (r.n, r.cluster_inertia, r.inertia) == (len(own), sum(own), sum(d for _, _, d in want))


def test_equal_vectors_and_none(spark):
    same = spark.createDataFrame([(i, [0.5, 0.5], 0, "", 0, "") for i in range(9)], KIND)
    found = centroid_clusters(same, 4, 2, 2)
    assert {(r.cluster, r.distance) for r in found.members.collect()} == {(0, 0)}
    assert sorted(r.n for r in found.centroids.collect()) == [0, 0, 0, 9]
    empty = centroid_clusters(same.filter("false"), 4, 2, 2)
    assert empty.members.count() == 0 and empty.centroids.count() == 0
    assert empty.members.dtypes == found.members.dtypes and empty.centroids.dtypes == found.centroids.dtypes


def test_too_large_components_are_an_error(spark):
    huge = spark.createDataFrame([(1, [1e30, 0.0], 0, "", 0, "")], KIND)
    with pytest.raises(Exception, match="reaches"):
        centroid_clusters(huge, 1, 1, 2).members.collect()


@pytest.mark.parametrize("size", [100, 1 << 26])
def test_changes_alone_keep_dot_products_right(size):
    rng = np.random.default_rng(size)
    v = rng.integers(-size, size, (50, 64))
    old = rng.integers(-size, size, (5, 64))
    new = old.copy()
    new[1, [3, 60]] += 7
    new[4] = rng.integers(-size, size, 64)
    changes = changed(old, new)
    assert [(c, len(p)) for c, p, _ in changes][0] == (1, 2) and [c for c, _, _ in changes] == [1, 4]
    dots = v @ old.T
    add_changes(v, dots, changes)
    assert (dots == v @ new.T).all()
    best, far = nearest(v, dots, new)
    full = ((v[:, None, :] - new[None]) ** 2).sum(axis=2)
    assert (far == full.min(axis=1)).all() and (best == full.argmin(axis=1)).all()
