"""Folders that hold damaged files: what can be read, and which files cannot, with the reason."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A file is opened whole to tell the reason only up to this size.
OPENED = 1 << 30


def _binary(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern is not None:
        files = files.option("pathGlobFilter", pattern)
    return files.load(path)


def listed_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, bytes, _encoded) of every file under `path` that holds any bytes; none is opened."""
    # Rows name their file in encoded form, which joins need; `file` can be opened.
    return _binary(spark, path, pattern).select(F.col("path").alias("file"), F.col("length").alias("bytes"), _file())


def empty_files(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    """Files without a byte, which scans leave out without a word."""
    # The driver's own list of the scan, of which only the names that no row has come back.
    listed = [(re.sub("^([^:/]+):/+", r"\1:/", unquote(f)),) for f in _binary(spark, path, pattern).inputFiles()]
    full = _binary(spark, path, pattern).select(F.regexp_replace("path", "^([^:/]+):/+", "$1:/").alias("file"))
    return [r[0] for r in spark.createDataFrame(listed, "file string").join(full, "file", "left_anti").collect()]


def read_undamaged(
    spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", pattern: str | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the rows of the files that can be read, and (file, bytes, reason) of the others.

    Every file's footer, or for text formats its content, is probed in parallel by a read
    that needs no column and passes over files it cannot read; what was listed but not met is
    a reject, unless it holds no rows. A file that is whole up to a broken page counts as
    readable here: `lost_rows` tells what is missing from it. The schema is given, so that
    no damaged file has to tell it. An empty folder gives no rows and no rejects.
    """
    def reader():
        r = spark.read.format(kind).schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
        if pattern is not None:
            r = r.option("pathGlobFilter", pattern)
        return r.options(**options)

    met = reader().load(path).select(_file()).distinct()
    missing = listed_files(spark, path, pattern).join(met, "_encoded", "left_anti")
    # Names of files, which the driver lists anyway for every scan.
    suspects = {r["file"]: r["bytes"] for r in missing.collect()}
    small = [f for f, n in suspects.items() if n <= OPENED]
    reasons = {}
    if small:
        opened = spark.read.format("binaryFile").load(small).select(F.col("path").alias("file"), "content")
        told = opened.mapInArrow(_parquet_reasons if kind == "parquet" else _text_reasons, "file string, reason string")
        reasons = {r["file"]: r["reason"] for r in told.collect()}
    rejected = [(f, n, reasons.get(f, "unreadable")) for f, n in suspects.items() if reasons.get(f, "unreadable") is not None]
    rejected += [(f, 0, "empty file") for f in empty_files(spark, path, pattern)]
    rejects = spark.createDataFrame(rejected, "file string, bytes long, reason string")
    return reader().load(path), rejects


def lost_rows(spark: SparkSession, path: str, rows: DataFrame, schema: StructType | str, pattern: str | None = None) -> DataFrame:
    """(file, expected, found) of the Parquet files whose pages give fewer rows than their footer says.

    `rows` is what was read, with its `_metadata` still at hand; only counts are compared.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
    reader = reader if pattern is None else reader.option("pathGlobFilter", pattern)
    expected = reader.parquet(path).select(_file()).groupBy("_encoded").agg(F.count(F.lit(1)).alias("expected"))
    # A comparison that always holds, but for which every column, and so every page, is read.
    seen = F.count_if(F.xxhash64(*rows.columns) >= F.lit(-(1 << 63)))
    found = rows.select(_file(), *rows.columns).groupBy("_encoded").agg(seen.alias("found"))
    both = listed_files(spark, path, pattern).join(expected, "_encoded").join(found, "_encoded", "left")
    return both.select("file", "expected", F.coalesce("found", F.lit(0)).alias("found")).filter("found < expected")


def _file() -> Column:
    return F.col("_metadata.file_path").alias("_encoded")


def _parquet_reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _told(batches, lambda data: pq.read_metadata(pa.BufferReader(data)).num_rows)


def _text_reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A text file without rows is whole; whether it is cut off shows in its compression alone.
    def rows(data: pa.Buffer) -> int:
        for kind, head in (("gzip", b"\x1f\x8b"), ("bz2", b"BZh"), ("zstd", b"\x28\xb5\x2f\xfd")):
            if data.to_pybytes()[: len(head)] == head:
                return len(pa.CompressedInputStream(pa.BufferReader(data), kind).read())
        return 0

    yield from _told(batches, rows)


def _told(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    for b in batches:
        reasons = []
        for content in b.column("content"):
            data = content.as_buffer()
            try:
                reasons.append(None if rows(data) == 0 else "rows unreadable")
            except Exception as e:  # noqa: BLE001 - whatever a damaged file makes the reader raise
                reasons.append(f"{type(e).__name__}: {e}".split("\n")[0])
        yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(reasons, pa.string())], ["file", "reason"])
