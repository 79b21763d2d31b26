"""What the operators need from the session: cut points, work folders, checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold at most this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where driver and executors are
    one process may a session go without; its temporary folder goes when Python ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            configured = tempfile.mkdtemp(prefix="reviewspark-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and go on from there.

    Used where a result is read more than once or where a loop would grow the plan. Later
    reads take only the columns they need, and the planner knows the size.
    """
    path = work_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames that `cut` returned, once nothing reads them any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of `df`, of `size` bytes each, stay within the limit together."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def broadcast_if_small(
    df: DataFrame, size: Column, limit: int = BROADCAST_BYTES, measured: DataFrame | None = None
) -> DataFrame:
    """Mark `df` for broadcast only after measuring that it (or `measured`) fits.

    A larger side is returned as it is; the join then shuffles, and adaptive execution
    splits a skewed key.
    """
    return F.broadcast(df) if fits(df if measured is None else measured, size, limit) else df


def deal_out(df: DataFrame, limit: int = 256 * 1024 * 1024, part: int = 1024 * 1024) -> DataFrame:
    """The rows of a small input in parts of about `part` bytes, whatever files they come from.

    A small file is one row group, which one task reads and works on alone. Up to `limit`
    bytes, as the planner measures the scan, the rows are shuffled once; a larger input has
    row groups enough and is returned as it is, without a shuffle. Filters and column
    choices of later steps still reach the scan.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(1, -(-size // part))) if size <= limit else df


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later filters may use without working it out again.

    Spark moves a filter below the projection that computes its column by repeating the
    expression there; it does not move one below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
