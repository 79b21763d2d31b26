"""Deterministic samples: the order is a hash of the key, so every run picks the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.operators.ranking import first_by_hash


def hash_key(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def fraction_sample(df: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """About `percent` in a hundred rows. No shuffle."""
    return df.filter(_point(key, seed) < F.lit((percent << 32) // 100))


def _point(key: str, seed: int) -> Column:
    """The first eight digits of the hash as a number in [0, 2^32)."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("bigint")


def sample_to_size(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """A fraction of the rows chosen so that about `most` remain (all of fewer). No shuffle."""
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(F.count(F.lit(1)), F.lit(1)))
    limit = df.agg(F.floor(share * F.lit(float(1 << 32)))).scalar()
    return df.filter(_point(key, seed) < limit)


def sample_per_group(
    df: DataFrame, group: list[str], key: str, most: int | Column, seed: int = 42
) -> DataFrame:
    """At most `most` rows per group in hash order."""
    return first_by_hash(
        df.withColumn("_hash", hash_key(key, seed)), group, "_hash", most, key, out="sample_no"
    ).drop("_hash")


def shuffled_head(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of the shuffled frame (each task keeps its own first n)."""
    return df.orderBy(hash_key(key, seed), key).limit(n)


def balanced_sample(
    df: DataFrame, label: str, key: str, most_negative: int = 50_000,
    most_positive: int = 10_000, times: int = 5, seed: int = 42,
) -> DataFrame:
    """Negatives up to a limit; positives up to min(limit, times x sampled negatives)."""
    negatives = F.least(F.count_if(~F.col(label)), F.lit(most_negative))
    cap = df.agg(F.least(F.lit(most_positive), negatives * times)).scalar()
    most = F.when(F.col(label), cap).otherwise(F.lit(most_negative))
    voted = df.filter(F.col(label).isNotNull())
    return sample_per_group(voted, [label], key, most, seed)
