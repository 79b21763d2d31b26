"""Ratios, percentages and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent_text(part: Column, whole: Column) -> Column:
    """`12.5%` with one decimal, `0.0%` when there is nothing to divide by.

    format_number rounds the exact binary value half to even, as the reports expect.
    """
    return F.concat(F.format_number(ratio(part, whole) * 100, 1), F.lit("%"))


def positive_share(voted_up: Column) -> Column:
    """Aggregate: percentage of rows that are positive; a missing vote is not positive."""
    return F.avg(F.when(voted_up, 1.0).otherwise(0.0)) * 100


def volume_bucket(n: Column, medium: int = 10_000, large: int = 50_000) -> Column:
    """large above `large`, medium from `medium` to `large` inclusive, small below."""
    return F.when(n > large, "large").when(n >= medium, "medium").otherwise("small")


def unit_bin(x: Column, bins: int) -> Column:
    """Bin of width 1 in [0, bins]; the last bin includes its right end, others give null."""
    inside = (x >= 0) & (x <= bins)
    return F.when(inside, F.least(F.floor(x), F.lit(bins - 1))).cast("int")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def adaptive_chunk(mean_length: Column, k: int) -> Column:
    """Chunk size by mean text length: short texts make larger chunks, long ones smaller."""
    return (
        F.when(mean_length < 100, F.lit(min(2 * k, 500)))
        .when(mean_length > 500, F.lit(max(k // 2, 50)))
        .otherwise(F.lit(k))
    )
