"""Positions, chunks and top rows inside groups, without one task per group.

A plain ``row_number`` puts a whole group into one task. Here the rows of a group are
first cut into slices that follow the order, counted, and only rows of one slice are
numbered together; the counts of the earlier slices give the offset.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.functions.arrays import with_value
from reviewspark.operators.joins import join_groups
from reviewspark.runtime import broadcast_if_small, cut

SLICE_ROWS = 50_000

# Up to this k a group is limited inside the map tasks only: the task that finishes a
# group then sees k rows from each of them.
MAP_SIDE_ROWS = 100


# At most this many slices, so that their boundaries stay a small list.
MOST_SLICES = 10_000


def ordered_slice(df: DataFrame, value: str, slices: int) -> Column:
    """Number of the slice a value falls in; slices follow the order and hold about equally many rows.

    Their boundaries are approximate quantiles of the rows, so neither far values nor a
    crowd in one place fills a slice; only equal values share one whatever their number.
    A row finds its slice by halving.
    """
    slices = max(1, min(slices, MOST_SLICES))
    if slices == 1:
        return F.lit(0)
    marks = [i / slices for i in range(1, slices)]
    found = df.agg(F.percentile_approx(value, marks, 10 * slices)).first()[0] or []
    kind = np.float64 if found and isinstance(found[0], float) else np.int64
    bounds = np.unique(np.array(found, kind))
    if not len(bounds):
        return F.lit(0)
    steps = [1 << i for i in range(slices.bit_length())][::-1]

    def place(b: Column) -> Column:
        def halve(at: Column, step: Column) -> Column:
            reached = (at + step <= len(bounds)) & (F.get(b, at + step - 1) <= F.col(value))
            return F.when(reached, at + step).otherwise(at)

        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)

    return with_value(F.lit(bounds), place)


def id_slice(df: DataFrame, order: str, rows: int = SLICE_ROWS) -> Column:
    """Slice number of a unique integer key, for slices of about `rows` rows each."""
    return ordered_slice(df, order, -(-df.count() // rows))


def hash_slice(order: str, digits: int = 3) -> Column:
    """Slice of a hexadecimal hash key: its leading digits."""
    return F.substring(order, 1, digits)


def _with_offsets(df: DataFrame, group: list[str], slice_: Column) -> DataFrame:
    """Adds `_slice` and `_before`, the number of rows of the group in earlier slices."""
    sliced = df.withColumn("_slice", slice_)
    keys = [*group, "_slice"]
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        sliced.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return join_groups(sliced, counts, keys)


def _numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    return df.withColumn(out, F.row_number().over(within) + F.col("_before")).drop(
        "_slice", "_before"
    )


def number_rows(
    df: DataFrame, group: list[str], order: str, out: str = "row_no", rows: int = SLICE_ROWS
) -> DataFrame:
    """1-based position of each row in its group by `order`, a unique integer key."""
    return _numbered(
        _with_offsets(df, group, id_slice(df, order, rows)), group, [order], out
    )


def first_rows(
    df: DataFrame, group: list[str], order: str, k: int, out: str = "row_no", rows: int = SLICE_ROWS
) -> DataFrame:
    """The first k rows of each group by a unique integer key; later slices are not ranked."""
    placed = _with_offsets(df, group, id_slice(df, order, rows)).filter(F.col("_before") < k)
    return _numbered(placed, group, [order], out).filter(F.col(out) <= k)


def first_by_hash(
    df: DataFrame, group: list[str], order: str, k: int | Column, tie: str, out: str = "row_no"
) -> DataFrame:
    """The first k rows of each group by a hexadecimal hash key, ties by `tie`.

    `k` may be a column that is constant in its group. Up to MAP_SIDE_ROWS rows Spark
    keeps k rows per group in every map task, which needs no counts of slices.
    """
    if isinstance(k, int) and k <= MAP_SIDE_ROWS:
        return top_rows(df, group, [F.col(order), F.col(tie)], k, out)
    placed = _with_offsets(df, group, hash_slice(order)).filter(F.col("_before") < k)
    return _numbered(placed, group, [order, tie], out).filter(F.col(out) <= k)


def top_rows(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group in any order, for small k.

    Spark keeps only k rows per group in every map task before it shuffles.
    """
    within = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(within)).filter(F.col(out) <= k)


def best_row(
    df: DataFrame, group: list[str], order: list[Column], key: str, payload: list[str]
) -> DataFrame:
    """The best row of each group; wide columns are fetched for the winners only."""
    winners = cut(top_rows(df.drop(*payload), group, order, 1).drop("rank"))
    wide = df.select(F.col(key).alias("_key"), *payload)
    # One row a group: while these fit, no wide row is shuffled.
    small = broadcast_if_small(winners, F.lit(64 * (len(winners.columns) + 1)))
    return wide.join(small, wide["_key"] == small[key]).select(*winners.columns, *payload)


def chunk_numbers(
    df: DataFrame, group: list[str], order: str, k: int | Column, out: str = "chunk_no"
) -> DataFrame:
    """0-based chunk of k consecutive rows per group; keeps the position as `row_no`."""
    return number_rows(df, group, order).withColumn(
        out, F.floor((F.col("row_no") - 1) / k).cast("bigint")
    )


def chunk_lists(
    df: DataFrame, group: list[str], order: str, value: str, k: int, out: str = "items"
) -> DataFrame:
    """The values of each group as ordered lists of at most k, one row per chunk.

    A list never grows beyond k, however large its group is; the chunks in order are
    the whole list.
    """
    return (
        chunk_numbers(df.filter(F.col(value).isNotNull()), group, order, k)
        .groupBy(*group, "chunk_no")
        .agg(F.sort_array(F.collect_list(F.struct("row_no", value))).alias("_pairs"))
        .withColumn(out, F.col(f"_pairs.{value}"))
        .drop("_pairs")
    )


def chunk_texts(
    df: DataFrame, group: list[str], order: str, value: str, k: int, separator: str = "\n\n"
) -> DataFrame:
    """Like `chunk_lists`, each chunk joined to one text."""
    return (
        chunk_lists(df, group, order, value, k, out="_items")
        .withColumn("chunk_size", F.size("_items"))
        .withColumn("chunk_text", F.array_join("_items", separator))
        .drop("_items")
    )


def relist(df: DataFrame, group: list[str], order: str, items: str, k: int) -> DataFrame:
    """Merge list cells: the elements of all rows of a group, in order, in lists of at most k.

    Rows follow `order`, a unique integer key; elements keep their place in the row.
    Offsets add up list sizes, first over slices of the order and then inside one.
    """
    sized = df.select(*group, order, F.size(items).alias("_size"))
    sliced = sized.withColumn("_slice", id_slice(sized, order))
    keys = [*group, "_slice"]
    earlier = lambda by, over: (
        Window.partitionBy(*by).orderBy(over).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        sliced.groupBy(*keys)
        .agg(F.sum("_size").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier(group, "_slice")), F.lit(0)))
        .drop("_total")
    )
    starts = join_groups(sliced, totals, keys).withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_size").over(earlier(keys, order)), F.lit(0))
    )
    return (
        join_groups(df, starts.select(*group, order, "_start"), [*group, order])
        .select(*group, "_start", F.posexplode_outer(items).alias("_pos", "_item"))
        .filter(F.col("_pos").isNotNull())
        .withColumn("_at", F.col("_start") + F.col("_pos"))
        .groupBy(*group, F.floor(F.col("_at") / k).cast("bigint").alias("chunk_no"))
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_item"))).alias("_pairs"))
        .withColumn(items, F.col("_pairs._item"))
        .drop("_pairs")
    )
