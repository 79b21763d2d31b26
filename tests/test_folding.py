"""Aggregates with a state of the user's own, and products with their themes."""

import random
import sys
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from reviewspark.operators.folding import Merged, TopValues, fold_groups, with_themes

cloudpickle.register_pickle_by_value(sys.modules[__name__])
TOP = "top array<struct<value: double, n: bigint, first_id: bigint>>"


def skewed(spark, n=6000):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([1, 2, None]), i, rng.choice([None, *map(float, range(40))]))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, h int, id long, x double").repartition(9)


@pytest.mark.parametrize("fan, held", [(32, 10_000), (1, 2), (3, 1)])
def test_largest_values(spark, fan, held):
    rows, df = skewed(spark)
    got = {(r.g, r.h): [tuple(t) for t in r.top] for r in fold_groups(
        df, ["g", "h"], ["x", "id"], TopValues("x", "id", 3), TOP, fan=fan, held=held).collect()}
    groups = defaultdict(list)
    for g, h, i, x in rows:
        groups[g, h].append((x, i))
    want = {}
    for k, own in groups.items():
        n = Counter(x for x, _ in own if x is not None)
        want[k] = [(x, n[x], min(i for y, i in own if y == x)) for x in sorted(n, reverse=True)[:3]]
    assert got == want


def test_lists_without_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, ["b", None, "a"]), (1, None), (1, ["c"]), (2, []), (None, ["z"])], "g int, words array<string>")
    got = {r.g: r.words for r in fold_groups(df, ["g"], ["words"], Merged("words", 2), "words array<string>").collect()}
    assert got == {1: ["a", "b"], 2: [], None: ["z"]}
    assert fold_groups(df.filter("false"), ["g"], ["words"], Merged("words", 2), "words array<string>").count() == 0
    with pytest.raises(ValueError):
        fold_groups(df, [], ["words"], Merged("words", 2), "words array<string>")
    with pytest.raises(ValueError):
        fold_groups(df, ["g"], ["words"], Merged("words", 2), "g array<string>")


def test_no_task_gets_a_hot_group(spark):
    rows, df = skewed(spark)
    seen = spark.sparkContext.accumulator(0)

    class Largest(TopValues):
        def merge(self, a, b):
            seen.add(len(b))
            return super().merge(a, b)

    fold_groups(df, ["g"], ["x", "id"], Largest("x", "id", 3), TOP).collect()
    # What is merged are states of three values for each task, not rows.
    assert 0 < seen.value <= 3 * 9 * 2 * 4


def test_products_in_slices_with_their_themes(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1] * 8 + [2, 3, None]), i) for i in range(500)]
    themes = [(1, "x"), (1, "y"), (2, "z"), (9, "w")]

    def make(key, own, theirs):
        assert own.num_rows <= 60
        told = ",".join(sorted(theirs.column("theme").to_pylist()))
        return pa.table([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([own.num_rows], pa.int64()),
                         pa.array([told])], ["app", "slice", "n", "told"])

    got = with_themes(spark.createDataFrame(rows, "app int, id long"), spark.createDataFrame(themes, "app int, theme string"),
                      "app", "id", make, "app int, slice long, n long, told string", most=60).collect()
    n = Counter(app for app, _ in rows)
    total, told = Counter(), {}
    for r in got:
        if r.n:
            total[r.app] += r.n
            told.setdefault(r.app, set()).add(r.told)
    assert total == n and told == {1: {"x,y"}, 2: {"z"}, 3: {""}, None: {""}}
    assert len(got) == sum(-(-x // 60) for x in n.values())
