"""Grouped measures that stay even when one group holds most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.functions.numbers import ratio
from reviewspark.operators.joins import join_groups


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sentiment_counts(df: DataFrame, *keys: str, voted_up: str = "voted_up") -> DataFrame:
    """Reviews, positive, negative and without a vote per group in one pass.

    `review_count` is the sum of the other three; a missing vote is no dislike.
    """
    vote = F.col(voted_up)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("review_count"),
        F.count_if(vote).alias("positive"),
        F.count_if(~vote).alias("negative"),
        F.count_if(vote.isNull()).alias("unvoted"),
    )


def merge_counts(partials: DataFrame, *keys: str) -> DataFrame:
    """Add up partial sentiment counts."""
    names = ["review_count", "positive", "negative", "unvoted"]
    return partials.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def positive_ratio(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Share of positive votes per group, for groups of at least `least` rows."""
    return (
        sentiment_counts(df, *keys)
        .filter(F.col("review_count") >= least)
        .withColumn("positive_ratio", ratio(F.col("positive"), F.col("positive") + F.col("negative")))
    )


def most_frequent(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The most frequent non-null value per group, the smallest on a tie.

    Counting (group, value) first spreads a large group over all tasks.
    """
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    within = Window.partitionBy(*group).orderBy(F.desc("_n"), F.col(value))
    return (
        counted.withColumn("_rank", F.row_number().over(within))
        .filter(F.col("_rank") == 1)
        .select(*group, F.col(value).alias(out))
    )


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, probs: dict[str, float], buckets: int = 1024
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Rows are first counted in at most `buckets` spans of value per group, combined in the
    map tasks, which tells the span each wanted rank falls in. Only the rows of those
    spans go on: their values are counted and put in order. Spans are cut at approximate
    quantiles of all rows, so that none holds much more than its share but for equal values,
    which count as one. Nulls and NaN are no values.
    """
    from reviewspark.operators.ranking import ordered_slice

    rows = df.select(*group, F.col(value).cast("double").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_b", ordered_slice(rows, "_v", buckets))
    whole = Window.partitionBy(*group)
    ordered = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        rows.groupBy(*group, "_b")
        .agg(F.count(F.lit(1)).alias("_in"))
        .withColumn("_through", F.sum("_in").over(ordered))
        .withColumn("_total", F.sum("_in").over(whole))
        .withColumn("_before", F.col("_through") - F.col("_in"))
    )
    ranks = {
        f"_{name}_{side}": fn((F.col("_total") - 1) * F.lit(p))
        for name, p in probs.items()
        for side, fn in (("lo", F.floor), ("hi", F.ceil))
    }
    wanted = reduce(
        lambda a, b: a | b,
        [(r >= F.col("_before")) & (r < F.col("_through")) for r in ranks.values()],
    )
    spans = spans.filter(wanted).select(*group, "_b", "_before", "_total")
    keys = [*group, "_b"]
    inside = (
        join_groups(rows, spans, keys)
        .groupBy(*keys, "_v", "_before", "_total")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    in_span = (
        Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = inside.withColumn("_end", F.col("_before") + F.sum("_n").over(in_span))
    at = lambda r: F.max(F.when((r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")), F.col("_v")))
    picked = placed.groupBy(*group).agg(
        F.max("_total").alias("_total"), *[at(r).alias(name) for name, r in ranks.items()]
    )
    return picked.select(
        *group, *[_between(name, p).alias(name) for name, p in probs.items()]
    )


def _between(name: str, p: float) -> Column:
    lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
    at = (F.col("_total") - 1) * F.lit(p)
    return lo + (hi - lo) * (at - F.floor(at))


def histogram(df: DataFrame, bin_: Column, name: str = "bin") -> DataFrame:
    """Rows per bin; rows outside every bin (null) are left out."""
    return counts_by(df.select(bin_.alias(name)).filter(F.col(name).isNotNull()), name)


def top_values(df: DataFrame, group: list[str], array: str, k: int = 3) -> DataFrame:
    """The k most frequent elements of a list column per group."""
    from reviewspark.operators.ranking import top_rows

    counted = counts_by(df.select(*group, F.explode(array).alias("value")), *group, "value")
    return top_rows(counted, group, [F.desc("n"), F.asc("value")], k)


def complete(domain: DataFrame, measures: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Every row of the domain, with 0 where there is no measure."""
    return domain.join(measures, keys, "left").fillna(0, subset=names)


def mean_vector(df: DataFrame, group: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Mean of equally long vectors per group.

    Element sums are combined before the shuffle, so a large group costs one row per
    dimension and map task.
    """
    return (
        df.select(*group, F.posexplode(vector).alias("_dim", "_x"))
        .groupBy(*group, "_dim")
        .agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("_dim", "_mean"))).alias("_pairs"))
        .select(*group, F.col("_pairs._mean").alias(out))
    )


def reconcile(listed: DataFrame, lists: str, source: DataFrame) -> DataFrame:
    """Rows in the exploded lists of a report next to rows of its source."""
    left = listed.select(F.explode_outer(lists).alias("x")).agg(F.count("x").alias("listed_rows"))
    right = source.agg(F.count(F.lit(1)).alias("source_rows"))
    return left.withColumn("source_rows", right.scalar()).withColumn(
        "matches", F.col("listed_rows") == F.col("source_rows")
    )
