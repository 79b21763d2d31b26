"""First looks at a collection: volume, sentiment, playtime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.numbers import positive_share, unit_bin, volume_bucket
from reviewspark.operators.aggregate import (
    counts_by,
    exact_quantiles,
    histogram,
    positive_ratio,
    top_values,
)


def top_volume(reviews: DataFrame, k: int = 100, key: str = "app_id") -> DataFrame:
    """The k products with the most reviews."""
    return counts_by(reviews, key, name="review_count").orderBy(F.desc("review_count"), key).limit(k)


def tail_of_top(reviews: DataFrame, k: int = 100, n: int = 5, key: str = "app_id") -> DataFrame:
    """The n weakest of the top k."""
    return top_volume(reviews, k, key).orderBy(F.asc("review_count"), F.desc(key)).limit(n)


def best_liked(reviews: DataFrame, least: int = 100, k: int = 20) -> DataFrame:
    """Products with the highest share of positive reviews among those with enough of them."""
    return (
        positive_ratio(reviews, "app_id", least=least)
        .orderBy(F.desc("positive_ratio"), "app_id")
        .limit(k)
    )


def playtime_stats(df: DataFrame, group: list[str], hours: str) -> DataFrame:
    """Count, mean, median and 95th percentile, all exact."""
    simple = df.groupBy(*group).agg(
        F.count(hours).alias("n"), F.avg(hours).alias("mean_hours")
    )
    quantiles = exact_quantiles(
        df.select(*group, hours), group, hours, {"median_hours": 0.5, "percentile_95_hours": 0.95}
    )
    return simple.join(quantiles, group)


def playtime_histogram(df: DataFrame, hours: str, bins: int = 999) -> DataFrame:
    """Rows per full hour below the outlier limit."""
    return histogram(df, unit_bin(F.col(hours), bins), "hour")


def playtime_overall(df: DataFrame, hours: str, below: float = 1000) -> DataFrame:
    """Mean and median of everything below the outlier limit."""
    kept = df.filter(F.col(hours) < below).select(hours)
    median = exact_quantiles(kept, [], hours, {"median_hours": 0.5})
    mean = kept.agg(F.avg(hours).alias("mean_hours"), F.count(hours).alias("n"))
    return mean.withColumn("median_hours", median.scalar())


def volume_buckets(reviews: DataFrame, medium: int = 10_000, large: int = 50_000) -> DataFrame:
    """Every product with its number of reviews and size class."""
    sized = counts_by(reviews, "app_id", name="review_count")
    return sized.withColumn("bucket", volume_bucket(F.col("review_count"), medium, large))


def topics_by_bucket(labelled: DataFrame, buckets: DataFrame) -> DataFrame:
    """Topics found per product, by size class."""
    found = labelled.groupBy("app_id").agg(F.countDistinct("topic").alias("n_topics"))
    return (
        found.join(buckets.select("app_id", "bucket"), "app_id")
        .select("app_id", "bucket", "n_topics")
        .orderBy(F.asc("bucket"), F.desc("n_topics"), F.asc("app_id"))
    )


def topic_profile(df: DataFrame, topic: str, hours: str, voted_up: str) -> DataFrame:
    """Size, mean playtime and share of positive reviews per topic; outliers left out."""
    return (
        df.filter(F.col(topic) >= 0)
        .groupBy(topic)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(hours).alias("avg_playtime"),
            positive_share(F.col(voted_up)).alias("pct_positive"),
        )
    )


def topic_values(df: DataFrame, topic: str, array: str, k: int = 3) -> DataFrame:
    """The most frequent elements of a list column per topic."""
    return top_values(df.filter(F.col(topic) >= 0), [topic], array, k)
