"""Exact top-k by inner product: branch and bound over vertical blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.llm.common import stored

SCALE = 1024
# Dimensions added up before the candidates are bounded and compacted again.
DIMS = 8
# Vectors of one candidate block and of one query block.
CANDIDATES = 4096
QUERIES = 512


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, null where a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(lists: pa.ListScalar, n: int) -> np.ndarray:
    """Row vectors as an (n, dims) array."""
    flat = lists.values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if len(flat) else np.zeros((n, 0), np.int64)


def _rest(columns: np.ndarray) -> np.ndarray:
    """Length of what is left of each vector before every block of dimensions: (blocks + 1, n)."""
    sq = columns.astype(np.float64) ** 2
    ends = range(0, len(columns) + DIMS, DIMS) if len(columns) else [0]
    return np.sqrt(np.array([sq[e:].sum(axis=0) for e in ends]))


def block_topk(
    q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, floors: dict[tuple[int, int], np.ndarray],
    q_keys: np.ndarray,
) -> list[tuple[int, int, int, int]]:
    """(query, query key, candidate, score) of each query's best k within one candidate block.

    `q` holds queries as rows, `c` candidates as columns (dimension first). After each
    block of dimensions a candidate's score lies within the sum so far plus or minus the
    product of both remaining lengths; a candidate whose upper end is below the k-th best
    lower end, or below the k-th best score this task has met for the query, is left out of
    the next block. Sums are exact: doubles where they fit 53 bits, else 64-bit integers.
    """
    dims = len(c)
    q_rest, c_rest = _rest(q.T), _rest(c)
    reach = float((q_rest[0].max(initial=0.0) + 1) * (c_rest[0].max(initial=0.0) + 1))
    kind = np.float64 if reach < 2**52 else np.int64
    q, c = q.astype(kind), np.ascontiguousarray(c.astype(kind))
    first = q[:, :DIMS] @ c[:DIMS]
    out = []
    for r in range(len(q)):
        alive = np.flatnonzero(c_ids != q_ids[r])
        score = first[r, alive]
        key = (int(q_ids[r]), int(q_keys[r]))
        best = floors.get(key, np.empty(0, np.int64))
        for step, at in enumerate(range(DIMS, dims + DIMS, DIMS), start=1):
            if not len(alive):
                break
            at_most = q_rest[min(step, len(q_rest) - 1), r] * c_rest[min(step, len(c_rest) - 1), alive] * (1 + 1e-9)
            low = score - at_most
            floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf
            if len(best) >= k:
                floor = max(floor, best[k - 1])
            keep = score + at_most >= floor - 0.5 - abs(floor) * 1e-9
            alive, score = alive[keep], score[keep]
            if at < dims:
                score = score + q[r, at : at + DIMS] @ c[at : at + DIMS, alive]
        score = score.astype(np.int64)
        order = np.lexsort((c_ids[alive], -score))[:k]
        out += [(*key, int(c_ids[alive[i]]), int(score[i])) for i in order]
        floors[key] = np.sort(np.concatenate([best, score[order]]))[::-1][:k]
    return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                q_ids, q_keys, c_ids = (
                    b.column(x)[i].values.to_numpy(zero_copy_only=False) for x in ("_q_ids", "_q_keys", "_c_ids"))
                q, c = _matrix(b.column("_q")[i], len(q_ids)), _matrix(b.column("_c")[i], len(c_ids))
                found = block_topk(q, q_ids, c.T, c_ids, k, floors, q_keys)
                cols = list(zip(*found)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in cols], ["query_id", "_q_key", "vec_id", "score"])

    return run


def _blocks(vectors: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (dims, block) holding about `size` vectors, and (dims, n blocks)."""
    n = stored(vectors.groupBy("_dims").agg(F.ceil(F.count("*") / size).cast("int").alias("_n")), "vector-counts")
    dealt = vectors.join(n, "_dims").select(
        "_dims", F.pmod(F.xxhash64("_id", "_key", F.lit(3)), "_n").cast("int").alias("_block"), "_id", "_key", "_v")
    rows = dealt.groupBy("_dims", "_block").agg(F.collect_list(F.struct("_id", "_key", "_v")).alias("_r"))
    return stored(rows, "vector-blocks"), n


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: int = SCALE, candidates: int = CANDIDATES, block: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products, ties to the smaller id.

    Components become floor(scale * x). Vectors that are null or hold a null or non-finite
    component, and rows with a null id, take no part. A candidate row that is repeated counts
    as often as it is there; a repeated query is one query. Rows that carry the query's id are
    its own and are left out; a query id with several vectors gives ranks for each, in which
    candidates of one id stay apart. Only vectors of the query's number of dimensions are compared. With fewer than k
    candidates all are returned. Scores are exact while they fit 63 bits.

    Every query block meets every candidate block of its dimensions once: the pairs are
    listed from the two block counts, dealt out over the tasks, and each is one bounded
    row. Only k rows a query leave a task's block.
    """
    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("_id"), scaled(F.col(vec_col), scale).alias("_v"))
        v = v.filter("_id is not null and _v is not null").groupBy("_id", "_v").agg(F.count("*").alias("_n"))
        return v.select("_id", F.xxhash64("_v").alias("_key"), F.size("_v").alias("_dims"), "_v", "_n")

    # Of equal rows no more than k can be among the k best.
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_n"), F.lit(k).cast("long")))).alias("_copy")
    each = clean(vectors).select("_id", "_key", "_dims", "_v", copies).drop("_copy")
    c_rows, c_n = _blocks(stored(each, "vectors"), candidates)
    q_rows, q_n = _blocks(stored(clean(queries).drop("_n"), "queries"), block)
    pairs = (
        c_n.withColumnRenamed("_n", "_c_n").join(q_n.withColumnRenamed("_n", "_q_n"), "_dims")
        .select("_dims", "_q_n", F.explode(F.sequence(F.lit(0), F.col("_c_n") - 1)).alias("_cb"))
        .select("_dims", "_cb", F.explode(F.sequence(F.lit(0), F.col("_q_n") - 1)).alias("_qb"))
    )
    left = q_rows.select("_dims", F.col("_block").alias("_qb"), F.col("_r._id").alias("_q_ids"),
                         F.col("_r._key").alias("_q_keys"), F.col("_r._v").alias("_q"))
    right = c_rows.select("_dims", F.col("_block").alias("_cb"), F.col("_r._id").alias("_c_ids"), F.col("_r._v").alias("_c"))
    joined = pairs.join(left, ["_dims", "_qb"]).join(right, ["_dims", "_cb"])
    joined = joined.select("_q_ids", "_q_keys", "_q", "_c_ids", "_c")
    found = joined.mapInArrow(_search(k), "query_id long, _q_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "_q_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
