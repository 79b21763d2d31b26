"""Files that keep arriving: flat ingest, running theme counts, running centroids.

Every micro-batch writes its result to a folder named after the batch. A batch that is
run again after a failure overwrites its own folder, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewspark.operators.aggregate import merge_counts, sentiment_counts
from reviewspark.operators.themes import nearest_vectors
from reviewspark.sources.raw_json import flatten, products


def ingest_documents(
    spark: SparkSession, source: str, target: str, checkpoint: str, whole_files: bool = True
) -> StreamingQuery:
    """New raw documents under `source` become flat review rows under `target`, once each."""
    texts = spark.readStream.option("wholetext", whole_files).text(source)
    return _start(flatten(products(texts)).writeStream.format("parquet").option("path", target), checkpoint)


def ingest_table(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet folder; a restart goes on where the last run stopped."""
    return _start(stream.writeStream.format("parquet").option("path", target), checkpoint)


def _start(writer, checkpoint: str) -> StreamingQuery:
    return (
        writer.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _each_batch(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _own_target(spark: SparkSession, target: str, checkpoint: str) -> None:
    """A target belongs to one checkpoint: refuse one that another run has filled."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(place: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(conf).exists(path)

    if there(target) and not there(checkpoint):
        raise ValueError(f"{target} holds the results of a run with another checkpoint")


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def count_themes(
    stream: DataFrame, assign: Callable[[DataFrame], DataFrame], keys: list[str], target: str, checkpoint: str
) -> StreamingQuery:
    """Partial counts of every batch under `target`; `running_counts` adds them up."""
    _own_target(stream.sparkSession, target, checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        counts = sentiment_counts(assign(batch), *keys)
        counts.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _each_batch(stream, checkpoint, step)


def running_counts(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    return merge_counts(spark.read.parquet(target).drop("batch"), *keys)


def move_centroids(
    stream: DataFrame, seeds: DataFrame, vector: str, target: str, checkpoint: str,
    labels: str | None = None, key: str | None = None,
) -> StreamingQuery:
    """Each batch is assigned with the centroids so far, which it then moves.

    The state is one row per topic and dimension: the sum and the number of vectors.
    Batch n reads the folder of batch n - 1 and writes its own. With `labels` every batch is
    then labelled by the moved centroids: (key, topic_id, similarity) under that folder.
    """
    spark = seeds.sparkSession
    _own_target(spark, target, checkpoint)
    start = seeds.select(
        "topic_id", F.posexplode("centroid").alias("dim", "total")
    ).withColumn("n", F.lit(1).cast("bigint"))
    start.write.mode("overwrite").parquet(f"{target}/state=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        state = spark.read.parquet(f"{target}/state={batch_id - 1}")
        placed = nearest_vectors(batch, centroids_of(state), vector, [], metric="euclidean")
        added = (
            placed.select("topic_id", F.posexplode(vector).alias("dim", "x"))
            .groupBy("topic_id", "dim")
            .agg(F.sum(F.col("x").cast("double")).alias("total"), F.count("x").alias("n"))
        )
        (
            state.unionByName(added)
            .groupBy("topic_id", "dim")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            .write.mode("overwrite")
            .parquet(f"{target}/state={batch_id}")
        )
        # A batch that is run again needs the state before it, and no older one.
        if batch_id > 0:
            _delete(spark, f"{target}/state={batch_id - 2}")
        if labels is not None:
            moved = centroids_of(spark.read.parquet(f"{target}/state={batch_id}"))
            named = nearest_vectors(batch, moved, vector, [], metric="euclidean")
            named.select(key, "topic_id", "similarity").write.mode("overwrite").parquet(f"{labels}/batch={batch_id}")

    return _each_batch(stream, checkpoint, step)


def centroids_of(state: DataFrame) -> DataFrame:
    """topic_id and centroid out of the running sums."""
    at = F.sort_array(F.collect_list(F.struct("dim", (F.col("total") / F.col("n")).alias("x"))))
    return state.groupBy("topic_id").agg(at.alias("_at")).select(
        "topic_id", F.col("_at.x").alias("centroid")
    )


def latest_centroids(spark: SparkSession, target: str) -> DataFrame:
    states = spark.read.parquet(target)
    last = states.agg(F.max("state")).scalar()
    return centroids_of(states.filter(F.col("state") == last))
