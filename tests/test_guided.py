"""Clusters that seeds guide: one step by hand, the order of rows, the way without a broadcast."""

import random
from collections import defaultdict

import numpy as np
import pytest

from reviewspark.operators import clusters


def dense(spark, seed=1, n=120):
    rng = np.random.default_rng(seed)
    rows = [(i, int(i % 2), rng.normal(size=3).tolist()) for i in range(n)] + [(900, 1, None), (901, 5, [1.0, 2.0, 3.0])]
    seeds = [(app, t, rng.normal(size=3).tolist()) for app in (0, 1) for t in (2, 5, 9)]
    return rows, seeds


@pytest.mark.parametrize("prior", [0.0, 7.5])
def test_one_step(spark, prior):
    rows, seeds = dense(spark)
    points = spark.createDataFrame(rows, "id long, app_id int, v array<double>")
    start = spark.createDataFrame(seeds + [(1, 30, [50.0, 50.0, 50.0])], "app_id int, topic_id int, centroid array<double>")
    got = {(r.app_id, r.topic_id): r.centroid for r in clusters.seeded_kmeans(points, start, ["app_id"], "v", 1, prior).collect()}
    members = defaultdict(list)
    for _, app, v in rows:
        own = [(round(sum((a - b) ** 2 for a, b in zip(v, c)), 9), t) for p, t, c in seeds if p == app] if v else []
        if own:
            members[app, min(own)[1]].append(np.array(v))
    for app, t, s in seeds + [(1, 30, [50.0, 50.0, 50.0])]:
        m = members[app, t]
        want = (sum(m) + prior * np.array(s)) / (len(m) + prior) if m else np.array(s)
        assert np.allclose(got[app, t], want)


def test_themes_keep_their_numbers_in_any_order(spark):
    rows, seeds = dense(spark, 2)
    rows = [r for r in rows if r[2]]
    start = spark.createDataFrame(seeds, "app_id int, topic_id int, centroid array<double>")
    found = set()
    for shuffle in range(3):
        mixed = random.Random(shuffle).sample(rows, len(rows))
        points = spark.createDataFrame(mixed, "id long, app_id int, v array<double>").repartition(shuffle + 1)
        centres = clusters.seeded_kmeans(points, start, ["app_id"], "v", 3, prior=20.0)
        placed = clusters.predict(points, centres, ["app_id"], "v").select("id", "topic_id")
        found.add(frozenset(map(tuple, placed.collect())))
        # A strong prior holds a centre within reach of its seed in every round.
        near = centres.join(start.withColumnRenamed("centroid", "seed"), ["app_id", "topic_id"]).collect()
        own = {(r.app_id, r.topic_id): np.linalg.norm(np.array(r.centroid) - r.seed) for r in near}
        others = {k: min(np.linalg.norm(np.array(r.centroid) - s) for a, t, s in seeds if a == k[0] and t != k[1])
                  for k in own for r in near if (r.app_id, r.topic_id) == k}
        assert all(own[k] < others[k] for k in own)
    assert len(found) == 1


def texts(seed):
    rng = random.Random(seed)
    docs = []
    for i in range(150):
        words = rng.sample("abcdefgh", rng.randint(0, 4))
        docs.append((i % 3, i, [(w, 1 / len(words) ** 0.5) for w in words]))
    seeds = [(app, t, w, 0.6) for app in (0, 1) for t, ws in ((0, "ab"), (1, "cd"), (4, "xy")) for w in ws]
    return docs, seeds


@pytest.mark.parametrize("prior", [0.0, 3.0])
def test_sparse_steps_with_and_without_a_broadcast(spark, prior):
    docs, seeds = texts(5)
    frame = spark.createDataFrame(docs, "app_id int, id long, weights array<struct<term: string, weight: double>>")
    start = spark.createDataFrame(seeds, "app_id int, topic_id int, term string, weight double")
    results = []
    for limit in (0, 1 << 20):
        centres, labels = clusters.seeded_text_kmeans(frame, start, "id", 2, prior=prior, limit=limit)
        results.append(({(r.app_id, r.topic_id, r.term): round(r.weight, 9) for r in centres.collect()},
                        {r.id: r.topic_id for r in labels.collect()}))
    assert results[0] == results[1]
    centres = defaultdict(dict)
    for app, t, w, x in seeds:
        centres[app, t][w] = x

    def nearest(app, text):
        far = [(round(sum(x * x for x in c.values()) - 2 * sum(c.get(w, 0) * x for w, x in text), 9), t)
               for (a, t), c in centres.items() if a == app]
        return min(far)[1] if far else 0

    first = {k: dict(c) for k, c in centres.items()}
    for _ in range(2):
        sums, n = defaultdict(lambda: defaultdict(float)), defaultdict(int)
        for app, _, text in docs:
            t = nearest(app, text)
            n[app, t] += 1
            for w, x in text:
                sums[app, t][w] += x
        for k in centres:
            if n[k] + prior:
                words = set(sums[k]) | (set(first[k]) if prior else set())
                centres[k] = {w: (sums[k][w] + prior * first[k].get(w, 0)) / (n[k] + prior) for w in words}
    assert results[0][0] == {(*k, w): round(x, 9) for k, c in centres.items() for w, x in c.items()}
    assert results[0][1] == {i: nearest(app, text) for app, i, text in docs}


def test_a_round_sends_sums_instead_of_entries(spark):
    rows = [(a, i, [("aa", 1.0), ("bb", 0.5)]) for a in (0, 1) for i in range(300)] + [(None, 1, [("aa", 1.0)]), (0, 2, []), (0, 3, None)]
    docs = spark.createDataFrame(rows, "app_id int, id long, weights array<struct<term: string, weight: double>>").coalesce(1)
    centres = spark.createDataFrame([(0, 2, "aa", 1.0), (0, 3, "cc", 1.0), (1, 4, "bb", 1.0)], "app_id int, topic_id int, term string, weight double")
    sums = clusters._term_sums(docs, centres, "id", "weights", 1 << 20).collect()
    assert len(sums) == len({(r.app_id, r.topic_id, r.term) for r in sums})
    got = {(r.app_id, r.topic_id, r.term): r.total for r in sums if r.app_id is not None}
    assert got == {(0, 2, "aa"): 300, (0, 2, "bb"): 150, (0, 2, None): 302,
                   (1, 4, "aa"): 300, (1, 4, "bb"): 150, (1, 4, None): 300}


def test_prior_must_not_be_negative(spark):
    with pytest.raises(ValueError):
        clusters.seeded_kmeans(None, None, [], "v", 1, prior=-1)
