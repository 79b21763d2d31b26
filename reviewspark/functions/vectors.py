"""Dense vectors as `array<double>`, sparse ones as `array<struct<term, tf>>`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def cosine(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity from a dot product and two norms; a zero vector is similar to nothing."""
    return F.when((norm_a > 0) & (norm_b > 0), product / (norm_a * norm_b)).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def first_best(scores: Column) -> Column:
    """0-based position of the highest score, the first one on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def term_norm(terms: Column, weight: str = "tf") -> Column:
    """Length of a sparse vector."""
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x[weight] * x[weight]))
