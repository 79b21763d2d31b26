"""What several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.runtime import work_dir

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
# A long text is taken apart in blocks of about this many bytes.
BLOCK_BYTES = 1 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    Cuts the lineage, survives lost executors, and keeps columns prunable. For what is
    read more than once.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a frame that `stored` returned, once nothing reads them any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column) -> Column:
    """64 bits of a text, null for null: with the id it tells rows apart that share an id."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), F.xxhash64(c))


def word_blocks(data: bytes, overlap: int, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lists of space-separated words that together hold every run of `overlap` + 1 words once.

    Each list starts with the last `overlap` words of the one before, so a text of any
    length is worked through in bounded memory.
    """
    tail: list[bytes] = []
    at = 0
    while at < len(data):
        stop = len(data)
        if stop - at > size and (m := _SPACE.search(data, at + size)):
            stop = m.start()
        words = tail + data[at:stop].split()
        yield words
        tail = words[-overlap:] if overlap else []
        at = stop


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that `df` already has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
