"""Texts to dense vectors with an exchangeable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.operators.themes import nearest_vectors, vector_centroids
from reviewspark.runtime import cut

# From a list of texts to one vector each.
Embedder = Callable[[list[str]], list[list[float]]]


def embed_column(text: Column, make: Callable[[], Embedder]) -> Column:
    """array<double> per text; `make` runs once per task, texts go through in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(list(model(batch.fillna("").tolist())))

    return embed(text)


def embedded_centroids(themes: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """Mean seed vector per theme. A theme without seeds has none and is never chosen
    over one with a positive similarity."""
    usable = F.filter("seeds", lambda s: F.coalesce(s, F.lit("")) != "")
    seeds = themes.select("app_id", "topic_id", F.explode(usable).alias("seed"))
    return vector_centroids(seeds.withColumn("embedding", embed_column(F.col("seed"), make)))


def assign_embedded(
    reviews: DataFrame, themes: DataFrame, make: Callable[[], Embedder], text: str = "review"
) -> DataFrame:
    """Reviews + topic_id with any embedding model."""
    centroids = cut(embedded_centroids(themes, make))
    embedded = reviews.withColumn("_embedding", embed_column(F.col(text), make))
    return nearest_vectors(embedded, centroids, "_embedding", ["app_id"]).drop("_embedding")
