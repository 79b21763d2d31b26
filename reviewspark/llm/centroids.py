"""Centroid clustering with an incremental distance matrix: exact integer dot products, kept per vector."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import drop_stored, stored

# Components up to this size keep every squared distance of 64 dimensions within 63 bits.
MOST = 1 << 27
# Sums below this are whole in doubles, which multiply as matrices.
WHOLE = float(1 << 52)


class Clusters(NamedTuple):
    """`members`: vec_id, cluster, distance. `centroids`: cluster, centroid, n, cluster_inertia, inertia."""

    members: DataFrame
    centroids: DataFrame


def integers(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of every component; null for another length and for null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < MOST)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return F.when(
        (F.size(vector) == dims) & finite,
        F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches {MOST}"))))


def changed(old: np.ndarray, new: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(centroid, places, differences) of the centroids that changed: the nonzero component changes alone."""
    step = new - old
    return [(c, np.flatnonzero(step[c]), step[c][step[c] != 0]) for c in np.flatnonzero(step.any(axis=1)).tolist()]


def add_changes(v: np.ndarray, dots: np.ndarray, changes: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Bring dot products (rows of vectors, columns of centroids) up to date, exactly."""
    reach = float(np.abs(v).max(initial=0))
    plain = v.astype(np.float64)
    for c, places, step in changes:
        if reach * float(np.abs(step).sum()) < WHOLE:
            dots[:, c] += (plain[:, places] @ step.astype(np.float64)).astype(np.int64)
        else:
            dots[:, c] += v[:, places] @ step


def nearest(v: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one on a tie, and the squared distance to it."""
    far = (v * v).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None, :]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    starts = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32())
    return pa.ListArray.from_arrays(starts, pa.array(m.ravel(), kind))


def _step(old: np.ndarray, new: np.ndarray):
    """Update of the kept rows from the centroids `old` to `new`, with the cluster and distance under `new`."""
    changes, k, dims = changed(old, new), len(new), new.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, dots = _matrix(b.column("_v"), dims), _matrix(b.column("_dots"), k)
            add_changes(v, dots, changes)
            cluster, far = nearest(v, dots, new)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("_v"), _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())],
                ["vec_id", "_v", "_dots", "cluster", "distance"])

    return run


def _means(rows: DataFrame, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every cluster's components; a cluster without vectors stays. One row a cluster is collected."""
    dims = old.shape[1]
    sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("_v", i)).alias(f"s{i}") for i in range(dims)])
    new = old.copy()
    for r in sums.collect():
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return new


def centroid_clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> Clusters:
    """k-means in integers: vectors become floor(scale * x), centroids floor(sum / count).

    The first centroids are the k vectors with the smallest sha256 of `1:<id>`, in ascending
    order of it. Each round assigns every vector to the nearest centroid (squared Euclidean
    distance, ties to the smaller number) and replaces every centroid that has vectors; then
    vectors are assigned once more.

    Every row keeps its dot products with all centroids. A round reads the rows once, adds
    the centroids' nonzero component changes to the dot products, recomputes the smallest
    distance, and writes the rows to the shared folder; the state of the round before goes.
    No vector is shuffled: only sums per cluster leave a task, and the driver holds k
    centroids.

    Vectors that are null, have another number of components, or hold a null or non-finite
    one take no part. Repeated rows each count. A row with a null id is a vector like any
    other, but comes last as a first centroid; rows with one id are ordered by their
    components. Fewer than k vectors give fewer centroids, none give empty results. Other
    columns are not read. Exact as long as components stay below 2^27 after scaling;
    larger ones end the query with an error, as their distances need more than 63 bits.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vec_col), dims, scale).alias("_v"))
    kept = stored(kept.filter("_v is not null"), "centroid-vectors")
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.withColumn("_hash", order).orderBy(F.col("_hash").asc_nulls_last(), "_v").limit(k).collect()
    now = np.array([r["_v"] for r in first], np.int64).reshape(len(first), dims)
    k = len(first)
    if not k:
        none = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clusters(none, spark.createDataFrame([], "cluster int, centroid array<long>, n long, cluster_inertia long, inertia long"))

    # From centroids of zeros, whose dot products are zeros, the first update is like any other.
    before, state = np.zeros_like(now), kept.withColumn("_dots", F.array_repeat(F.lit(0).cast("long"), k))
    used = kept
    for i in range(rounds + 1):
        step = state.mapInArrow(_step(before, now), "vec_id long, _v array<int>, _dots array<long>, cluster int, distance long")
        if i == rounds:
            step = step.select("vec_id", "cluster", "distance")
        rows = stored(step, "centroid-state")
        drop_stored(used)
        if i < rounds:
            before, now, state = now, _means(rows, now), rows
        used = rows
    found = {r["cluster"]: (r["n"], r["far"]) for r in
             rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("far")).collect()}
    total = sum(far for _, far in found.values())
    table = [(c, now[c].tolist(), *found.get(c, (0, 0)), total) for c in range(k)]
    return Clusters(rows, spark.createDataFrame(table, "cluster int, centroid array<long>, n long, cluster_inertia long, inertia long"))
