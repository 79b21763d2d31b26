"""Clustering that starts from the themes, and topics without seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.operators.aggregate import mean_vector
from reviewspark.operators.ranking import top_rows
from reviewspark.operators.themes import TermIndex, assign_by_index, nearest_vectors, sums_by_index
from reviewspark.runtime import BROADCAST_BYTES, broadcast_if_small, cut, discard, fits


def seeded_kmeans(
    points: DataFrame, seeds: DataFrame, keys: list[str], vector: str, rounds: int, prior: float = 0.0
) -> DataFrame:
    """k-means whose i-th centre starts as theme i, so that cluster numbers are topic ids.

    With `keys` every product is clustered for itself, all of them in the same jobs. With a
    `prior` the seeds stay part of the objective, sum |x - c|^2 + prior * sum |c - seed|^2:
    a centre moves to the mean of its points and of `prior` more points at its seed, so
    the themes guide every round and not only the first. A theme that lost all its points
    goes back to its seed, or without a prior keeps its last centre. Returns keys,
    topic_id, centroid.
    """
    if prior < 0:
        raise ValueError("prior must not be negative")
    centres = cut(seeds.select(*keys, "topic_id", "centroid", F.col("centroid").alias("_seed")))
    for _ in range(rounds):
        placed = nearest_vectors(points, centres.drop("_seed"), vector, keys, metric="euclidean")
        moved = mean_vector(placed, [*keys, "topic_id"], vector, out="_moved")
        if prior:
            sized = placed.groupBy(*keys, "topic_id").agg(F.count(F.lit(1)).alias("_n"))
            moved = moved.join(sized, [*keys, "topic_id"])
            pulled = F.zip_with("_moved", "_seed", lambda x, s: (x * F.col("_n") + s * prior) / (F.col("_n") + prior))
            new = F.coalesce(pulled, "_seed")
        else:
            new = F.coalesce("_moved", "centroid")
        further = cut(centres.join(moved, [*keys, "topic_id"], "left").select(*keys, "topic_id", new.alias("centroid"), "_seed"))
        discard(centres)
        centres = further
    return centres.drop("_seed")


def predict(points: DataFrame, centres: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return nearest_vectors(points, centres, vector, keys, metric="euclidean")


def nearest_terms(
    docs: DataFrame, centres: DataFrame, key: str, weights: str = "weights"
) -> DataFrame:
    """Nearest centre of unit-length sparse vectors: app_id, key, topic_id.

    Centres are a long table (app_id, topic_id, term, weight). The squared distance is
    |c|^2 - 2 x.c + 1, so only centres that share a term need a product; the shortest
    centre stands for all the others. A text whose product has no centre gets topic 0.
    """
    lengths = centres.groupBy("app_id", "topic_id").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("c2")
    )
    plain = F.struct(F.round("c2", 9).alias("d"), "topic_id")
    shortest = lengths.groupBy("app_id").agg(F.min(plain).alias("far"))
    side = broadcast_if_small(centres, F.length(F.col("term").cast("string")) + 64)
    entries = docs.select("app_id", key, F.inline_outer(weights)).filter(F.col("term").isNotNull())
    shared = (
        entries.join(side.withColumnRenamed("weight", "c"), ["app_id", "term"])
        .groupBy("app_id", key, "topic_id")
        .agg(F.sum(F.col("weight") * F.col("c")).alias("xc"))
        .join(lengths, ["app_id", "topic_id"])
        .withColumn("d", F.round(F.col("c2") - 2 * F.col("xc"), 9))
        .groupBy("app_id", key)
        .agg(F.min(F.struct("d", "topic_id")).alias("near"))
    )
    return (
        docs.select("app_id", key)
        .join(shared, ["app_id", key], "left")
        .join(shortest, "app_id", "left")
        .select("app_id", key, F.least(F.coalesce("near", "far"), "far").alias("best"))
        .select("app_id", key, F.coalesce("best.topic_id", F.lit(0)).alias("topic_id"))
    )


def nearest_centres(
    docs: DataFrame, centres: DataFrame, key: str, weights: str = "weights", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """`docs` with topic_id: by an index of the centres while they fit a broadcast, else by `nearest_terms`."""
    if fits(centres, F.length(F.col("term").cast("string")) + 64, limit):
        index = TermIndex.of(centres.select("app_id", "topic_id", "term", "weight").toArrow())
        return assign_by_index(docs, index, F.col(weights), metric="euclidean").drop("similarity")
    return docs.join(nearest_terms(docs, centres, key, weights), ["app_id", key])


def _term_sums(docs: DataFrame, centres: DataFrame, key: str, weights: str, limit: int) -> DataFrame:
    """(app_id, topic_id, term, total) of the texts nearest to each centre; a null term counts them. Parts are still to be added."""
    if fits(centres, F.length(F.col("term").cast("string")) + 64, limit):
        return sums_by_index(docs, TermIndex.of(centres.select("app_id", "topic_id", "term", "weight").toArrow()), weights)
    own = F.struct(F.lit(None).cast("string").alias("term"), F.lit(1.0).alias("total"))
    entries = F.transform(weights, lambda e: F.struct(e["term"].cast("string").alias("term"), e["weight"].alias("total")))
    # One entry more counts the text itself.
    labelled = docs.join(nearest_terms(docs, centres, key, weights), ["app_id", key])
    return labelled.select("app_id", "topic_id", F.inline(F.concat(entries, F.array(own))))


def seeded_text_kmeans(
    docs: DataFrame, seeds: DataFrame, key: str, rounds: int, weights: str = "weights", prior: float = 0.0,
    limit: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """`seeded_kmeans` on sparse vectors that stay sparse, with the same `prior`.

    Returns the centres (app_id, topic_id, term, weight) and the labels of the last round.
    A round reads the texts' weights once: each text gets its label where it is read, and
    only sums per topic and term leave the task, in Python's batches while the centres fit a broadcast.
    """
    if prior < 0:
        raise ValueError("prior must not be negative")
    seeds = cut(seeds.select("app_id", "topic_id", "term", "weight"))
    # A product without seeds has nothing to move: its texts keep topic 0.
    seeded = seeds.select("app_id").distinct()
    centres = seeds
    for _ in range(rounds):
        sums = cut(
            _term_sums(docs.select("app_id", key, weights), centres, key, weights, limit)
            .groupBy("app_id", "topic_id", "term").agg(F.sum("total").alias("total"))
            .join(seeded, "app_id", "left_semi"))
        sized = sums.filter("term is null").select("app_id", "topic_id", F.col("total").alias("n"))
        totals = sums.filter("term is not null")
        if prior:
            pull = seeds.select("app_id", "topic_id", F.col("term").cast("string").alias("term"), (F.col("weight") * prior).alias("total"))
            totals = totals.unionByName(pull).groupBy("app_id", "topic_id", "term").agg(F.sum("total").alias("total"))
            moved = totals.join(sized, ["app_id", "topic_id"], "left").select(
                "app_id", "topic_id", "term", (F.col("total") / (F.coalesce("n", F.lit(0.0)) + prior)).alias("weight"))
        else:
            moved = totals.join(sized, ["app_id", "topic_id"]).select(
                "app_id", "topic_id", "term", (F.col("total") / F.col("n")).alias("weight"))
            moved = moved.unionByName(centres.join(sized, ["app_id", "topic_id"], "left_anti").withColumn("term", F.col("term").cast("string")))
        further = cut(moved)
        if centres is not seeds:
            discard(centres)
        discard(sums)
        centres = further
    return centres, nearest_centres(docs, centres, key, weights, limit).select("app_id", key, "topic_id")


def free_topics(
    points: DataFrame, key: str, vector: str, topics: int, components: int = 5,
    outliers: float = 0.95, seed: int = 42,
) -> DataFrame:
    """Topics without seeds: reduce, cluster, and give far points topic -1.

    Returns key, topic, distance (in the reduced space) and the reduced vector.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    features = points.select(
        key, array_to_vector(F.col(vector).cast("array<double>")).alias("features")
    )
    pca = PCA(k=components, inputCol="features", outputCol="reduced").fit(features)
    reduced = cut(pca.transform(features).select(key, "reduced"))
    model = KMeans(k=topics, seed=seed, featuresCol="reduced", predictionCol="cluster").fit(reduced)
    # As many rows as topics: a bounded local table.
    centres = reduced.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cluster int, centre array<double>",
    )
    placed = (
        model.transform(reduced)
        .join(F.broadcast(centres), "cluster")
        .withColumn("reduced", vector_to_array("reduced"))
        .withColumn(
            "distance",
            F.sqrt(
                F.aggregate(
                    F.zip_with("reduced", "centre", lambda x, y: (x - y) * (x - y)),
                    F.lit(0.0),
                    lambda acc, x: acc + x,
                )
            ),
        )
    )
    limit = placed.agg(F.percentile_approx("distance", outliers)).scalar()
    return placed.select(
        key,
        F.when(F.col("distance") > limit, F.lit(-1)).otherwise(F.col("cluster")).alias("topic"),
        "distance",
        "reduced",
    )


def representatives(placed: DataFrame, topic: str, key: str, similarity: str, k: int = 3) -> DataFrame:
    """The k rows closest to the centre of their topic."""
    return top_rows(placed, [topic], [F.desc(similarity), F.asc(key)], k)
