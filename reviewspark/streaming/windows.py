"""Counts of a stream per window of event time, kept in the state store."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewspark.runtime import cut, discard


def count_windows(
    stream: DataFrame, keys: list[str], time: str, length: str, delay: str, measures: list[Column], target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Measures per window of `length` and keys, added up as the stream arrives.

    The sums live in Spark's state store, one entry for each open window and keys; a restart
    goes on from `checkpoint`. `delay` is how late a row may come: one whose window has ended
    before the latest time seen, less the delay, is left out (`late_rows` counts them), and
    the window's entry leaves the store. Rows without a time are in no window.

    Only entries that changed leave a batch. They replace the ones of before in the table
    under `target`, of which `current` reads the latest version: its size is that of
    the result, however many batches there were. A version is a folder named after its batch,
    so a batch that is run again writes the same; older versions than the one before are deleted.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        changed = cut(batch)  # worked out once: it is read twice
        before = versions(spark, target)
        rows = changed
        if batch_id - 1 in before:
            old, new = _version(spark, target, batch_id - 1).alias("old"), changed.select("start", *keys).alias("new")
            same = F.lit(True)
            for name in ("start", *keys):
                same = same & F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))
            rows = old.join(new, same, "left_anti").unionByName(changed)
        rows.write.mode("overwrite").parquet(f"{target}/version={batch_id}")
        discard(changed)
        for number in before:
            if number < batch_id - 1:
                _delete(spark, f"{target}/version={number}")

    window = F.window(time, length).alias("_window")
    counted = stream.withWatermark(time, delay).groupBy(window, *keys).agg(*measures)
    counted = counted.select("_window.start", "_window.end", *[c for c in counted.columns if c != "_window"])
    writer = counted.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """(start, end, keys, measures): every window with what has been counted so far."""
    there = versions(spark, target)
    if not there:
        raise ValueError(f"{target} holds no counts")
    return _version(spark, target, max(there))


def late_rows(query: StreamingQuery) -> int:
    """Rows (or entries of rows that a task had added up) that came after their window had left the store."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the versions that are whole."""
    path, files = _path(spark, target)
    if not files.exists(path):
        return []
    found = [str(f.getPath()) for f in files.listStatus(path)]
    numbers = [int(m[1]) for f in found if (m := re.search(r"/version=(\d+)$", f))]
    return sorted(n for n in numbers if files.exists(_path(spark, f"{target}/version={n}/_SUCCESS")[0]))


def _version(spark: SparkSession, target: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{target}/version={number}")


def _path(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, place: str) -> None:
    path, files = _path(spark, place)
    files.delete(path, True)
