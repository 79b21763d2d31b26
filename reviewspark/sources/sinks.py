"""Writing reviews and reports, and reading a saved report back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewspark.functions.arrays import list_cell
from reviewspark.schema import REPORT_NAMES

# Larger files are split, so that one product never becomes one file of any size.
ROWS_PER_FILE = 5_000_000
# A CSV file with line breaks in its fields is read back by one task.
ROWS_PER_CSV = 200_000


def write_products(df: DataFrame, path: str, app_id: str = "app_id", mode: str = "overwrite") -> None:
    """Snappy Parquet, one folder per product.

    The rebalance brings the rows of a product together to avoid many small files, and
    adaptive execution splits a large product over several tasks.
    """
    (
        df.hint("rebalance", app_id)
        .write.mode(mode)
        .partitionBy(app_id)
        .option("compression", "snappy")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .parquet(path)
    )


def lists_as_json(df: DataFrame) -> DataFrame:
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({n: F.to_json(n) for n in lists})


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite") -> None:
    """CSV with header; list cells become JSON text.

    Quotes inside a field are doubled; with `quote_all` every field is quoted and a
    backslash escapes.
    """
    (
        lists_as_json(df)
        .write.mode(mode)
        .option("header", True)
        .option("maxRecordsPerFile", ROWS_PER_CSV)
        .option("quoteAll", quote_all)
        .option("escape", "\\" if quote_all else '"')
        .option("emptyValue", '""')
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str, quote_all: bool = False) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", "\\" if quote_all else '"')
        .option("comment", "#")
        .option("emptyValue", "")
        .csv(path)
    )


def read_report(spark: SparkSession, path: str, schema: str, lists: list[str]) -> DataFrame:
    """A saved report with its list cells as lists again: the point to go on from."""
    saved = read_csv(spark, path, schema)
    return saved.withColumns({n: list_cell(F.col(n)) for n in lists})


def deliver(report: DataFrame) -> DataFrame:
    """The report under the names and in the order its readers know."""
    return report.select(*[F.col(n).alias(out) for n, out in REPORT_NAMES.items() if n in report.columns])


def write_topic_words(top: DataFrame, path: str, topic: str = "topic", mode: str = "overwrite") -> None:
    """JSON, one object per topic with its words and scores (k words per topic)."""
    words = F.sort_array(
        F.collect_list(F.struct("rank", F.col("term").alias("word"), F.col("weight").alias("score")))
    )
    (
        top.groupBy(topic)
        .agg(F.transform(words, lambda w: F.struct(w["word"], w["score"])).alias("words"))
        .write.mode(mode)
        .json(path)
    )
