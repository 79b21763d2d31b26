"""Operators against brute force on small data, among it one group that holds most rows."""

import hashlib
import math
import random
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reviewspark.functions import arrays
from reviewspark.operators import aggregate, clusters, keywords, ranking, resume, sampling, summaries, themes
from reviewspark.plans import report
from reviewspark.runtime import broadcast_if_small, cut, fits
from reviewspark.sources.themes import parse_themes

# The summarisers below are sent to the workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, a null group, sparse ids."""
    rng = random.Random(1)
    ids = rng.sample(range(-(10**12), 10**12), 3000)
    rows = [(rng.choice(["hot", "hot", "hot", "hot", "a", "b", None]), i, rng.choice("xyz")) for i in ids]
    return spark.createDataFrame(rows, "g string, id bigint, v string").cache(), rows


def by_group(rows):
    groups = defaultdict(list)
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        groups[g].append((i, v))
    return groups


@pytest.mark.parametrize("slice_rows", [1, 7, 100, 10**6])
def test_row_numbers(skewed, slice_rows):
    df, rows = skewed
    got = {(r.g, r.id): r.row_no for r in ranking.number_rows(df, ["g"], "id", rows=slice_rows).collect()}
    want = {(g, i): n for g, items in by_group(rows).items() for n, (i, _) in enumerate(items, 1)}
    assert got == want


def test_random_64_bit_keys(spark):
    ids = [-(2**63), -5, 0, 7, 2**62, 2**63 - 1]
    df = spark.createDataFrame([("g", i) for i in ids], "g string, id bigint")
    got = [r.id for r in ranking.number_rows(df, ["g"], "id", rows=2).orderBy("row_no").collect()]
    assert got == ids


def test_first_rows(skewed):
    df, rows = skewed
    got = {(r.g, r.id) for r in ranking.first_rows(df, ["g"], "id", 5, rows=10).collect()}
    assert got == {(g, i) for g, items in by_group(rows).items() for i, _ in items[:5]}


@pytest.mark.parametrize("k", [1, 10, 3000])
def test_chunks_reassemble(skewed, k):
    df, rows = skewed
    chunks = ranking.chunk_lists(df, ["g"], "id", "v", k).collect()
    assert max(len(c["items"]) for c in chunks) <= k
    whole = defaultdict(list)
    for c in sorted(chunks, key=lambda c: c.chunk_no):
        whole[c.g] += c["items"]
    assert whole == {g: [v for _, v in items] for g, items in by_group(rows).items()}


def test_relist(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", None]), i, [f"{i}-{j}" for j in range(rng.randrange(4))]) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id bigint, items array<string>")
    whole = defaultdict(list)
    for r in sorted(ranking.relist(df, ["g"], "id", "items", 9).collect(), key=lambda r: r.chunk_no):
        assert len(r["items"]) <= 9
        whole[r.g] += r["items"]
    want = defaultdict(list)
    for g, _, items in rows:
        want[g] += items
    assert whole == want


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    values = {"hot": rng.lognormal(3, 4, 2000), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), "same": np.full(9, 4.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None)], "g string, x double")
    got = aggregate.exact_quantiles(df, ["g"], "x", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, buckets=50)
    for r in got.collect():
        want = np.quantile(values[r.g], [0.5, 0.95, 0.0, 1.0])
        assert np.allclose([r.p50, r.p95, r.p0, r.p100], want)
    assert got.count() == len(values)
    flat = aggregate.exact_quantiles(df.filter("g = 'same'"), [], "x", {"m": 0.5}).collect()
    assert [r.m for r in flat] == [4.0]


def test_most_frequent_takes_smallest(spark):
    df = spark.createDataFrame([("f", "b"), ("f", "a"), ("f", None), ("f", None), ("e", None)], "file string, x string")
    assert [tuple(r) for r in aggregate.most_frequent(df, ["file"], "x", "m").collect()] == [("f", "a")]


def test_samples_are_repeatable_and_whole(skewed):
    df, rows = skewed
    sizes = Counter(g for g, _, _ in rows)
    for most in (40, 1500):
        first = sampling.sample_per_group(df, ["g"], "id", most).select("g", "id").collect()
        again = sampling.sample_per_group(df.repartition(5), ["g"], "id", most).select("g", "id").collect()
        assert set(first) == set(again)
        assert Counter(r.g for r in first) == {g: min(n, most) for g, n in sizes.items()}
    near = sampling.sample_to_size(df, "id", 300).count()
    assert 200 < near < 400 and sampling.sample_to_size(df, "id", 10**6).count() == 3000


def test_large_k_equals_small_k_path(skewed):
    df, _ = skewed
    hashed = df.withColumn("h", sampling.hash_key("id"))
    plain = {r.id for r in ranking.first_by_hash(hashed, ["g"], "h", 30, "id").collect()}
    sliced = {r.id for r in ranking.first_by_hash(hashed, ["g"], "h", F.lit(30), "id").collect()}
    assert plain == sliced


def test_best_row_ties(spark):
    df = spark.createDataFrame([(1, 5, 10, "late"), (1, 3, 10, "first"), (1, 1, 2, "low"), (2, 9, 0, "only")], "g int, id int, votes int, t string")
    got = ranking.best_row(df, ["g"], [F.desc("votes"), F.asc("id")], "id", ["t"]).collect()
    assert {r.g: r.t for r in got} == {1: "first", 2: "only"}


THEMES = '{"1": {"fight": ["combat arena", "fast"], "story": ["plot", null, ""], "empty": []}, "2": {"same": ["red"], "twin": ["red"]}}'


@pytest.fixture(scope="module")
def dictionary(spark):
    return parse_themes(spark.createDataFrame([(THEMES,)], "value string"))


def test_theme_file_order(dictionary):
    rows = dictionary.orderBy("app_id", "topic_id").collect()
    assert [(r.app_id, r.topic_id, r.theme) for r in rows] == [
        (1, 0, "fight"), (1, 1, "story"), (1, 2, "empty"), (2, 0, "same"), (2, 1, "twin"),
    ]


def review_frame(spark):
    rows = [
        (1, 1, "Combat and more combat", True), (2, 1, "a fine plot", False), (3, 1, "", True), (4, 1, None, True),
        (5, 2, "red red", False), (6, 3, "no themes here", True), (7, 1, "nothing known", True),
    ]
    return spark.createDataFrame(rows, "review_id bigint, app_id int, review string, voted_up boolean")


def test_assignment_edges(spark, dictionary):
    got = {r.review_id: (r.topic_id, round(r.similarity, 6)) for r in themes.assign_by_text(review_frame(spark), dictionary).collect()}
    # The seeds of `fight` are (combat, arena) / sqrt 2 and (fast); their mean has length sqrt(1/2).
    assert got[1] == (0, round(2 * (0.5 / 2**0.5) / (6**0.5 * 0.5**0.5), 6))
    assert got[2] == (1, round(1 / 2**0.5, 6))
    assert got[3] == got[4] == got[7] == (0, 0.0)
    assert got[5] == (0, 1.0) and got[6] == (0, 0.0)


def test_assignment_without_broadcast(spark, dictionary):
    packed = themes.pack_seeds(dictionary)
    assert broadcast_if_small(packed, F.lit(100), limit=100) is packed
    joined = themes.assign_by_text(review_frame(spark), dictionary, limit=0)
    index = themes.assign_by_text(review_frame(spark), dictionary)
    assert joined.columns == index.columns and set(joined.collect()) == set(index.collect())
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_assignment_against_plain_cosines(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    dictionary = [(app, t, f"t{t}", [" ".join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(rng.randint(0, 4))])
                  for app in range(6) for t in rng.sample(range(20), app)]
    reviews = [(i, rng.choice([*range(8), None]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 25)))])) for i in range(400)]
    frame = spark.createDataFrame(reviews, "review_id long, app_id int, review string")
    seeds = spark.createDataFrame(dictionary, "app_id int, topic_id int, theme string, seeds array<string>")

    def unit(counts):
        length = math.sqrt(sum(x * x for x in counts.values()))
        return {w: x / length for w, x in counts.items()} if length else {}

    def best(app, text):
        review, found = unit(Counter((text or "").split())), []
        for a, t, _, texts in dictionary:
            usable = [x for x in texts if x]
            total = Counter()
            for x in usable:
                for w, weight in unit(Counter(x.split())).items():
                    total[w] += weight / len(usable)
            if a == app:
                found.append((-round(sum(x * review.get(w, 0) for w, x in unit(total).items()), 9), t))
        far, topic = min(found, default=(0, 0))
        return topic, round(-far, 6) + 0.0

    want = {i: best(app, text) for i, app, text in reviews}
    for limit in (0, 1 << 20):
        got = themes.assign_by_text(frame, seeds, limit=limit).collect()
        assert {r.review_id: (r.topic_id, round(r.similarity, 6)) for r in got} == want
    none = themes.assign_by_text(frame, seeds.filter("false")).collect()
    assert {(r.topic_id, r.similarity) for r in none} == {(0, 0.0)}
    assert themes.assign_by_text(frame.filter("false"), seeds).count() == 0


@pytest.mark.parametrize("buckets", [3, 1 << 18])
def test_hashed_vectors(spark, buckets):
    texts = ["one two two three four five six one one", "", None, "alone", " ".join(f"word{i % 40}" for i in range(90))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in themes.hashed_vectors(df, "t", buckets, ["five"]).collect():
        words = [w for w in (texts[r.i] or "").split() if w != "five"]
        n = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets for w in words)
        length = math.sqrt(sum(x * x for x in n.values()))
        assert [(b.term, round(b.weight, 9)) for b in r.buckets] == [(b, round(n[b] / length, 9)) for b in sorted(n)]


def test_hashed_vectors_of_a_long_text(spark):
    """Very many distinct words that meet in buckets cost no more for each of them."""
    words, buckets = [f"word{i}" for i in range(150_000)], 1 << 15
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    start = time.perf_counter()
    found = themes.hashed_vectors(df, "t", buckets).first().buckets
    assert time.perf_counter() - start < 15
    n = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets for w in words)
    length = math.sqrt(sum(x * x for x in n.values()))
    assert [(b.term, round(b.weight, 9)) for b in found] == [(b, round(n[b] / length, 9)) for b in sorted(n)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("keys", [[], ["app_id"]])
def test_batches_equal_expressions(spark, metric, keys):
    """Both ways to the nearest centroid agree: ties, zero and missing vectors, products without themes."""
    rng = np.random.default_rng(4)
    points = [(i, i % 4, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(300)]
    points += [(900, 1, [0.0] * 5), (901, 1, None)]
    df = spark.createDataFrame(points, "id int, app_id int, v array<float>")
    centres = [(a, t, [float(x) for x in rng.integers(-2, 3, 5)]) for a in range(3) for t in range(3)]
    centres += [(a, 3, centres[a * 3][2]) for a in range(3)] + [(a, 4, [0.0] * 5) for a in range(3)]
    centroids = spark.createDataFrame(centres, "app_id int, topic_id int, centroid array<double>")
    if not keys:
        centroids = centroids.filter("app_id = 0").drop("app_id")
    assert fits(centroids, F.size("centroid") * 8) and not fits(centroids, F.size("centroid") * 8, 100)
    batches = themes.nearest_vectors(df, centroids, "v", keys, metric)
    other = themes.nearest_vectors(df, centroids, "v", keys, metric, limit=300)
    columns = ["id", "topic_id", F.round("similarity", 6).alias("s")]
    assert set(batches.select(*columns).collect()) == set(other.select(*columns).collect())


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_two_keys_and_odd_vectors(spark, metric):
    points = [(1, "x", 1, [1.0, 0.0]), (2, "x", 2, [1.0, 0.0]), (3, "y", 1, [0.0, 1.0]), (4, "x", 1, [1.0, 2.0, 3.0]),
              (5, "x", 1, [None, 1.0]), (6, None, 1, [1.0, 0.0]), (7, "x", 1, None), (8, "x", 1, [])]
    df = spark.createDataFrame(points, "id int, a string, b int, v array<double>")
    centres = [("x", 1, 0, [0.0, 1.0]), ("x", 1, 1, [1.0, 0.0]), ("x", 2, 5, [0.0, 1.0]), ("y", 1, 7, [1.0, 1.0]),
               ("x", 1, 2, [1.0, 2.0, 3.0]), ("x", 1, 3, [None, 0.0]), ("x", 1, 4, None)]
    centroids = spark.createDataFrame(centres, "a string, b int, topic_id int, centroid array<double>")
    want = {1: 1, 2: 5, 3: 7, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0}
    for limit in (10**6, 1):
        got = themes.nearest_vectors(df, centroids, "v", ["a", "b"], metric, limit=limit).collect()
        assert {r.id: r.topic_id for r in got} == want
        assert all(r.similarity == 0 for r in got if r.id > 4)


@pytest.mark.parametrize("far", [[10**15, 10**15 + 1], [-(10**15)], []])
def test_slices_are_even(spark, far):
    ids = [*range(20_000), *far]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    sizes = df.groupBy(ranking.id_slice(df, "id", 1000).alias("s")).count().collect()
    assert max(r["count"] for r in sizes) <= 2000 and len(sizes) >= 15
    placed = df.select("id", ranking.id_slice(df, "id", 1000).alias("s")).orderBy("id").collect()
    assert [r.s for r in placed] == sorted(r.s for r in placed)


@pytest.mark.parametrize("odd", [[-1e7], [1e300], [5.0] * 3000, [float("nan")] * 10 + [None]])
def test_quantiles_of_odd_values(spark, odd):
    rng = random.Random(5)
    values = [rng.uniform(0, 1000) for _ in range(4000)] + odd
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = aggregate.exact_quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.95}).first()
    kept = [v for v in values if v is not None and v == v]
    assert np.allclose([got.m, got.q], np.quantile(kept, [0.5, 0.95]))
    spans = df.filter("v is not null and not isnan(v)").groupBy(ranking.ordered_slice(df, "v", 100).alias("s")).agg(
        F.countDistinct("v").alias("n")).collect()
    assert max(r.n for r in spans) <= 2 * len(kept) / 100


def test_report_edges(spark, dictionary):
    counts = report.theme_report(review_frame(spark).filter("review is not null"), dictionary)
    rows = {(r.app_id, r.topic_id): r for r in counts.collect()}
    assert rows[(3, 0)].theme == "Unknown Theme 0"
    assert all(r.positive + r.negative + r.unvoted == r.review_count for r in rows.values())
    assert sum(r.review_count for r in rows.values()) == 6
    full = report.completed(counts, dictionary).collect()
    assert len(full) == 5
    empty = next(r for r in full if r.theme == "empty")
    assert (empty.review_count, empty.like_ratio, empty.dislike_ratio) == (0, "0.0%", "0.0%")


def test_partials_equal_one_shot(spark, dictionary):
    placed = themes.assign_by_text(review_frame(spark).filter("review is not null"), dictionary)
    merged = report.merged_report(report.partial_counts(placed, "review_id", 2), dictionary)
    names = ["app_id", "topic_id", "review_count", "positive", "negative", "like_ratio"]
    assert set(merged.select(*names).collect()) == set(report.report_of(placed, dictionary).select(*names).collect())


def test_seeded_kmeans_keeps_empty_centres(spark):
    points = spark.createDataFrame([(1, [0.0, 0.1]), (2, [0.1, 0.0]), (3, [5.0, 5.0])], "id int, v array<double>")
    seeds = spark.createDataFrame([(0, [0.0, 0.0]), (1, [4.0, 4.0]), (2, [99.0, 99.0])], "topic_id int, centroid array<double>")
    centres = {r.topic_id: r.centroid for r in clusters.seeded_kmeans(points, seeds, [], "v", 3).collect()}
    assert centres[2] == [99.0, 99.0] and np.allclose(centres[0], [0.05, 0.05]) and centres[1] == [5.0, 5.0]


def test_resume(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    done = spark.createDataFrame([(1, "old"), (2, "old")], "id int, s string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "id int, s string")
    assert [r.id for r in resume.remaining(todo, done, ["id"]).collect()] == [3]
    merged = resume.merge_checkpoint(done, new, ["id"], "s").collect()
    assert {r.id: r.s for r in merged} == {1: "old", 2: "new", 3: "new"}


def joiner():
    return lambda text: f"<{text}>"


@pytest.mark.parametrize("n", [1, 3, 4, 6, 7, 30])
def test_hierarchy(spark, n):
    """Chunk edges k, k+1 and 2k, and more chunks than fit one level."""
    rows = [("g", i, f"r{i}") for i in range(n)] + [("h", 0, "x"), ("h", 1, None)]
    df = spark.createDataFrame(rows, "g string, id bigint, t string")
    got = {r.g: r.summary for r in summaries.hierarchical_summary(df, ["g"], "id", "t", 3, joiner, fan_in=4).collect()}

    def level(parts, size, sep):
        return [f"<{sep.join(parts[i:i + size])}>" for i in range(0, len(parts), size)]

    want = level([f"r{i}" for i in range(n)], 3, "\n\n")
    while len(want) > 1:
        want = level(want, 4, " ")
    assert got == {"g": want[0], "h": "<x>"}


def test_adaptive_chunks(spark):
    rows = [("short", i, "x") for i in range(130)] + [("long", i, "y" * 600) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id bigint, t string")
    sizes = summaries.chunk_sizes(df, ["g"], "t", 60)
    assert {r.g: r.chunk_size for r in sizes.collect()} == {"short": 120, "long": 50}
    got = summaries.hierarchical_summary(df, ["g"], "id", "t", 60, joiner, sizes=sizes).collect()
    assert {r.g: r.summary.count("<") for r in got} == {"short": 3, "long": 3}


def broken():
    def fail(text):
        raise RuntimeError("no model")

    return fail


def test_failing_model_still_reports(spark):
    df = spark.createDataFrame([("g", 1, "z" * 300)], "g string, id bigint, t string")
    row = summaries.hierarchical_summary(df, ["g"], "id", "t", 5, broken, attempts=2).first()
    assert row.summary == "z" * 200 + "..." and row.error == "RuntimeError: no model"


def test_sentinels(spark):
    rows = [(1, 0, 1, "good", True), (1, 1, 2, "bad", False)]
    df = spark.createDataFrame(rows, "app_id int, topic_id int, id bigint, t string, voted_up boolean")
    told = summaries.sentiment_summaries(df, "id", "t", 5, joiner)
    by = {r.topic_id: r for r in told.collect()}
    assert by[0].negative_summary == summaries.NO_NEGATIVE and by[1].positive_summary == summaries.NO_POSITIVE
    counts = spark.createDataFrame([(1, 0), (1, 2)], "app_id int, topic_id int")
    full = {r.topic_id: r.positive_summary for r in summaries.add_summaries(counts, told).collect()}
    assert full == {0: "<good>", 2: summaries.NOT_AVAILABLE}


def test_leading_sentences(spark):
    texts = ["One two. Combat combat! combat is fun?\n", "", None, "...", "b a. a b. c c c. a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    told = {r.i: r.s for r in df.select("i", summaries.leading_sentences(F.col("t"), 1).alias("s")).collect()}
    assert told == {0: "Combat combat", 1: "", 2: None, 3: "", 4: ""}
    plan = df.select(summaries.summary_column(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan


def middle_fails():
    def model(text):
        if "bad" in text:
            raise ValueError("cannot read this")
        return f"<{len(text)}>"

    return model


def test_errors_go_up_the_levels(spark):
    rows = [("g", i, "bad" if i == 5 else f"text {i}") for i in range(12)] + [("h", 0, "fine")]
    df = spark.createDataFrame(rows, "g string, id bigint, t string")
    got = {r.g: r for r in summaries.hierarchical_summary(df, ["g"], "id", "t", 2, middle_fails, fan_in=2).collect()}
    # The beginning that stands in for the failed chunk still holds the word, so the level above fails too.
    assert got["g"].failed >= 1 and got["g"].error == "ValueError: cannot read this"
    assert (got["h"].failed, got["h"].error) == (0, None)
    with pytest.raises(ValueError):
        summaries.hierarchical_summary(df, ["g"], "id", "t", 2, middle_fails, fan_in=1)


def test_best_row_moves_no_text(spark):
    df = spark.range(100).selectExpr("id % 5 AS g", "id", "id * 7 % 11 AS votes", "repeat('x', 50) AS t")
    plan = ranking.best_row(df, ["g"], [F.desc("votes"), F.asc("id")], "id", ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_terms_are_counted_in_many_tasks(spark, monkeypatch):
    """Texts that lie in one task, as a join may leave them, are spread; so are their terms."""
    seen = []
    monkeypatch.setattr(keywords, "TASK_CHARS", 500)
    monkeypatch.setattr(keywords, "TASK_TERMS", 100)
    monkeypatch.setattr(keywords, "cut", lambda df: seen.append(df.rdd.getNumPartitions()) or cut(df))
    docs = spark.createDataFrame([("a", i, f"w{i} x{i % 7} y{i % 5}") for i in range(500)], "topic string, id int, t string").coalesce(1)
    weights = keywords.tfidf_weights(docs, "topic", "id", "t")
    assert seen[0] >= 10 and {r.term for r in weights.collect()} >= {"w3", "w3 x3", "x3 y3"}


def test_topics_are_found_in_slices(monkeypatch):
    monkeypatch.setattr(arrays.in_slices, "__defaults__", (5,))
    lists, sizes = pa.array([["a", "b"], ["c"] * 4, None, ["d"] * 7, ["e"]], pa.list_(pa.string())), []
    apps = pa.array([3, 4, 5, 6, 7], pa.int32())

    def score(apps, lists):
        sizes.append(len(lists.flatten()))
        return np.array(apps), np.array([len(x or []) for x in lists.to_pylist()], float)

    found = themes._scored(apps, lists, score).to_pylist()
    assert [(r["topic_id"], r["similarity"]) for r in found] == [(3, 2), (4, 4), (5, 0), (6, 7), (7, 1)]
    assert sum(sizes) == 14 and sorted(sizes)[-2] <= 5
