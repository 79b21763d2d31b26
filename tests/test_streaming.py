"""Window counts out of the state store: batches, restarts and late rows; sketches next to exact measures."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewspark.catalogue import QUERIES
from reviewspark.operators import sketches
from reviewspark.runtime import work_dir
from reviewspark.streaming import windows

KIND = "id long, ts timestamp, kind string, x double"
START = dt.datetime(2024, 3, 1)


def arrive(spark, path, name, rows):
    """One more file of the stream."""
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{path}/{name}")


def run(spark, path, target, checkpoint, delay="2 hours"):
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    measures = [F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")]
    query = windows.count_windows(stream, ["kind"], "ts", "1 hour", delay, measures, target, checkpoint)
    query.awaitTermination()
    return query


def hours(spark, target):
    return {(int((r.start - START).total_seconds() // 3600), r.kind): (r.n, r.total) for r in windows.current(spark, target).collect()}


def test_batches_restart_and_late_rows(spark):
    path, target, checkpoint = (work_dir(spark, x) for x in ("in", "out", "progress"))
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    arrive(spark, path, "a", [(1, at(0), "v", 1.0), (2, at(0, 59), None, 2.0), (3, at(1), "v", 4.0), (4, None, "v", 9.0)])
    run(spark, path, target, checkpoint)
    assert hours(spark, target) == {(0, "v"): (1, 1.0), (0, None): (1, 2.0), (1, "v"): (1, 4.0)}
    # The second run starts from the checkpoint: the first file is not counted again.
    arrive(spark, path, "b", [(5, at(0, 30), "v", 8.0), (6, at(9), "w", 16.0)])
    run(spark, path, target, checkpoint)
    assert hours(spark, target) == {(0, "v"): (2, 9.0), (0, None): (1, 2.0), (1, "v"): (1, 4.0), (9, "w"): (1, 16.0)}
    # Now 09:00 has been seen, so rows of windows that ended before 07:00 come too late.
    arrive(spark, path, "c", [(7, at(0, 45), "v", 32.0), (8, at(8, 5), "v", 64.0)])
    query = run(spark, path, target, checkpoint)
    assert hours(spark, target)[0, "v"] == (2, 9.0) and hours(spark, target)[8, "v"] == (1, 64.0)
    assert windows.late_rows(query) == 1
    # Without new files nothing changes, and no more than two versions are kept.
    before = hours(spark, target)
    run(spark, path, target, checkpoint)
    assert hours(spark, target) == before and len(windows.versions(spark, target)) <= 2


def test_many_batches_equal_one_count(spark):
    rng = random.Random(1)
    path, target, checkpoint = (work_dir(spark, x) for x in ("in", "out", "progress"))
    want = defaultdict(lambda: [0, 0.0])
    for batch in range(6):
        rows = [(i, START + dt.timedelta(minutes=rng.randrange(600)), rng.choice(["hot"] * 8 + ["a", "b", None]), float(rng.randrange(9)))
                for i in range(200)]
        arrive(spark, path, f"p{batch}", rows)
        for _, ts, kind, x in rows:
            key = int((ts - START).total_seconds() // 3600), kind
            want[key] = [want[key][0] + 1, want[key][1] + x]
    run(spark, path, target, checkpoint, "1 day")
    assert hours(spark, target) == {k: tuple(v) for k, v in want.items()}


def test_no_counts(spark):
    with pytest.raises(ValueError):
        windows.current(spark, work_dir(spark, "nothing"))


def test_sketches_merge_and_stay_within_their_bounds(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 9 + ["cold"]), dt.date(2024, 1, 1 + rng.randrange(5)), rng.choice([None, float("nan"), *[rng.gauss(0, 9) for _ in range(8)]]),
             rng.choice([None, *["often"] * 3, f"item{rng.randrange(3000)}"])) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "app string, day date, x double, item string").repartition(7)
    path = work_dir(spark, "days")
    sketches.put_days(sketches.sketches(df, ["app", "day"], "x", "item"), path, "day")
    assert sketches.read_days(spark, path, "2024-01-02", "2024-01-03").select("day").distinct().count() == 2
    # A day is replaced by fewer rows; the others stay.
    day = dt.date(2024, 1, 2)
    kept = [r for i, r in enumerate(rows) if r[1] != day or i % 2]
    half = spark.createDataFrame([r for r in kept if r[1] == day], df.schema)
    sketches.put_days(sketches.sketches(half, ["app", "day"], "x", "item"), path, "day")
    whole = sketches.merged(sketches.read_days(spark, path), ["app"])
    found = whole.select("app", "n", sketches.quantile(0.25).alias("q"), sketches.rank_of(0.0).alias("r"),
                         sketches.distinct_count().alias("d"), sketches.frequent_items(1).alias("top")).collect()
    for r in found:
        own = [x for x in kept if x[0] == r.app]
        values = sorted(x[2] for x in own if x[2] is not None and x[2] == x[2])
        items = Counter(x[3] for x in own if x[3] is not None)
        assert r.n == len(own)
        rank = sum(v <= r.q for v in values) / len(values)
        assert abs(rank - 0.25) <= 2 * sketches.RANK_ERROR
        assert abs(r.r - sum(v <= 0 for v in values) / len(values)) <= 2 * sketches.RANK_ERROR
        assert abs(r.d / len(items) - 1) <= 4 * sketches.DISTINCT_ERROR
        assert (r.top[0]["item"], r.top[0]["count"]) == ("often", items["often"])
    none = sketches.sketches(df.filter("x is null"), ["app"], "x", "item").select("app", sketches.quantile(0.5).alias("q"), "n")
    assert all(r.q is None and r.n > 0 for r in none.collect())
    assert sketches.sketches(df.filter("false"), ["app"], "x", "item").count() == 0


def test_most_frequent_users_among_very_many_alike(spark, tmp_path):
    """More users than a sketch tracks, none of them much more frequent than the others."""
    rows = spark.range(90_000).select(
        F.lit("view").alias("event_type"), (F.col("id") % 40_000).alias("user_id"),
        F.col("id").cast("double").alias("value"), F.lit("2024-01-05").cast("timestamp").alias("ts"))
    rows.withColumn("user_id", F.when(F.col("value") < 4, 7).when(F.col("value") > 89_990, None).otherwise(F.col("user_id"))).write.parquet(
        f"{tmp_path}/events.parquet")
    found = QUERIES["sketched_days"](spark, str(tmp_path)).collect()
    assert [(r.n, list(r.top_counts)) for r in found] == [(90_000, [7, 3, 3])]
