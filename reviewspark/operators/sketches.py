"""Measures that can be added up later: quantiles, distinct counts and frequent values as sketches per group and day.

A sketch is a small binary value. Sketches of several days or products merge into one without
a second look at the rows, so a day can be put in anew while the others stay as they are.
Spark's own sketch functions do the work, with partial sketches in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accuracy: a quantile's rank is off by about 1.7 % of the rows at most (99 of 100 times), a distinct
# count by 1.6 % on average; a frequent value's count is off by 1 / 3,500 of the rows at most.
RANK_K = 200
RANK_ERROR = 0.017
DISTINCT_BITS = 12
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_BITS / 2)
TRACKED = 10_000


def sketches(df: DataFrame, keys: list[str], value: str, item: str) -> DataFrame:
    """(keys, n, values, distinct, frequent) per group: sketches of a number and of an item.

    Nulls and NaN are no values, a null item is no item; `n` counts all rows. A group without
    values has a null sketch for them.
    """
    number = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.kll_sketch_agg_double(F.when(~F.isnan(number), number), RANK_K).alias("values"),
        F.hll_sketch_agg(item, DISTINCT_BITS).alias("distinct"),
        F.call_function("approx_top_k_accumulate", F.col(item), F.lit(TRACKED)).alias("frequent"),
    )


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups as those of `keys`: days as months, products as all products."""
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.kll_merge_agg_double("values", RANK_K).alias("values"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"),
    )


def quantile(prob: float) -> Column:
    """The value whose rank among the group's values is about `prob`; null without values."""
    return F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(prob)))


def rank_of(value: float) -> Column:
    """Share of the group's values up to `value`, about; null without values."""
    return F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_rank_double("values", F.lit(float(value))))


def distinct_count() -> Column:
    return F.hll_sketch_estimate("distinct")


def frequent_items(k: int) -> Column:
    """The k most frequent items with their counts, most frequent first, as far as the sketch can tell.

    Items whose count is within the sketch's error are left out: of very many items that
    are all about as frequent none may be left.
    """
    return F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k))


def put_days(parts: DataFrame, path: str, day: str) -> None:
    """Write the sketches of whole days under `path`; days that are there are replaced, others stay untouched."""
    parts.write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, day: str = "day") -> DataFrame:
    """Sketches of the days from `first` to `last`; only their folders are read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col(day) >= F.lit(first).cast("date"))
    if last is not None:
        df = df.filter(F.col(day) <= F.lit(last).cast("date"))
    return df
