"""Files that say what they hold: a sink that writes key and value pairs into every file, and reads them back.

Parquet files carry them in the footer, CSV files as `# key: value` lines on top. Files are
written aside first and moved to their place when every task is done, so that a failed
task or job leaves nothing behind.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from reviewspark.sources.sinks import ROWS_PER_CSV, ROWS_PER_FILE, lists_as_json

FORMAT = "labelled_files"
STAGING = "_staging"


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    if ":" not in path.split("/", 1)[0]:
        return pyarrow.fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (place aside, name in the target)."""

    files: list[tuple[str, str]]


class LabelledFiles(DataSource):
    """The sink for Spark: options `path`, `kind` (parquet or csv), `key` and `rows` per file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.key = options["path"].rstrip("/"), options["kind"], options["key"]
        self.rows, self.overwrite = int(options["rows"]), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = place(self.path)
        aside = f"{base}/{STAGING}/{self.job}"
        files.create_dir(aside, recursive=True)
        done: list[tuple[str, str]] = []
        open_: _File | None = None
        for batch in iterator:
            column = batch.column(batch.schema.get_field_index(self.key))
            # Rows of a key come together: a file ends where the next key begins.
            for value in pc.unique(column):
                rows = batch.filter(pc.is_null(column) if not value.is_valid else pc.fill_null(pc.equal(column, value), False))
                while rows.num_rows:
                    if open_ is not None and (open_.value != value.as_py() or open_.n >= self.rows):
                        open_.close()
                        open_ = None
                    if open_ is None:
                        name = f"{self.key}={quote(str(value.as_py()), safe='')}-{uuid.uuid4().hex}.{self.kind}"
                        open_ = _File(files, f"{aside}/{name}", self.kind, self.key, value.as_py(), batch.schema)
                        done.append((f"{aside}/{name}", name))
                    some = rows.slice(0, self.rows - open_.n)
                    open_.add(some)
                    rows = rows.slice(some.num_rows)
        if open_ is not None:
            open_.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = place(self.path)
        before = files.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)) if self.overwrite else []
        for m in messages:
            for aside, name in m.files if m is not None else ():
                files.move(aside, f"{base}/{name}")
        for f in before:
            if f.is_file:
                files.delete_file(f.path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, base = place(self.path)
        aside = f"{base}/{STAGING}/{self.job}"
        if files.get_file_info(aside).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(aside)
        rest = files.get_file_info(pyarrow.fs.FileSelector(f"{base}/{STAGING}", allow_not_found=True))
        if not rest and files.get_file_info(f"{base}/{STAGING}").type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(f"{base}/{STAGING}")


class _File:
    """One file of one key; its pairs tell the key, how many rows it holds and when it was written."""

    def __init__(self, files: pyarrow.fs.FileSystem, path: str, kind: str, key: str, value, schema: pa.Schema):
        self.files, self.path, self.kind, self.key, self.value, self.n = files, path, kind, key, value, 0
        self.batches: list[pa.RecordBatch] = []
        self.parquet = pq.ParquetWriter(path, schema, filesystem=files, compression="snappy") if kind == "parquet" else None

    def add(self, rows: pa.RecordBatch) -> None:
        self.n += rows.num_rows
        if self.parquet is not None:
            self.parquet.write_batch(rows)
        else:
            # The number of rows stands on top, so they are held until it is known: at most one file's.
            self.batches.append(rows)

    def close(self) -> None:
        now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
        pairs = {self.key: str(self.value), "total_reviews": str(self.n), "processed_at": now}
        if self.parquet is not None:
            self.parquet.add_key_value_metadata(pairs)
            self.parquet.close()
            return
        with self.files.open_output_stream(self.path) as out:
            out.write("".join(f"# {k}: {v}\n" for k, v in pairs.items()).encode())
            options = pyarrow.csv.WriteOptions(quoting_style="all_valid")
            pyarrow.csv.write_csv(pa.Table.from_batches(self.batches), out, options)


def write_labelled(
    df: DataFrame, path: str, key: str, kind: str = "parquet", mode: str = "overwrite", rows: int | None = None
) -> None:
    """One or more files for each value of `key` under `path`, each with its own pairs.

    Parquet is Snappy; CSV quotes every field, doubles quotes inside, and writes list cells as
    JSON. `mode` is overwrite, which replaces the files that were there once the new ones are
    in place, or append. A value of more than `rows` rows gets several files. A null key gets
    files of its own, named None. No rows, no files.
    """
    if kind not in ("parquet", "csv"):
        raise ValueError(f"no such kind of file: {kind}")
    df.sparkSession.dataSource.register(LabelledFiles)
    most = rows or (ROWS_PER_FILE if kind == "parquet" else ROWS_PER_CSV)
    flat = lists_as_json(df) if kind == "csv" else df
    # The rebalance brings a value's rows together, and adaptive execution splits a large one.
    laid = flat.hint("rebalance", key).sortWithinPartitions(key)
    laid.write.format(FORMAT).mode(mode).option("kind", kind).option("key", key).option("rows", most).save(path)


def read_labels(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """(file, labels) with the pairs of every file under `path` as a map; of a file only its footer or top is read."""
    from reviewspark.sources.damaged import listed_files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(_pairs(f, kind).items()) for f in b.column("file").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), pa.array(found, pa.map_(pa.string(), pa.string()))], ["file", "labels"])

    return listed_files(spark, path, f"*.{kind}").select("file").mapInArrow(run, "file string, labels map<string, string>")


def _pairs(file: str, kind: str) -> dict[str, str]:
    files, path = place(file)
    if kind == "parquet":
        with files.open_input_file(path) as f:
            found = pq.read_metadata(f).metadata or {}
        return {k.decode(): v.decode() for k, v in found.items() if not k.startswith((b"ARROW:", b"org.apache.spark"))}
    out = {}
    with files.open_input_stream(path) as f:
        top = f.read(1 << 16).decode("utf-8", "replace")
    for line in top.split("\n"):
        if not line.startswith("# "):
            break
        k, _, v = line[2:].partition(": ")
        out[k] = v
    return out
