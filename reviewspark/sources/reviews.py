"""Reading flat reviews: many files at once, pruned and filtered at the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.operators.aggregate import most_frequent
from reviewspark.schema import NAME_COLUMNS, REPORT_INPUT, REVIEWS


def read_reviews(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All review files under `path` (a folder or a pattern), only the wanted columns."""
    return spark.read.schema(REVIEWS).parquet(path).select(*(columns or REPORT_INPUT))


def usable_reviews(df: DataFrame, language: str = "english", keep_null_text: bool = False) -> DataFrame:
    """Reviews in one language; rows without text are dropped unless asked for."""
    spoken = df.filter(F.col("review_language") == language)
    if keep_null_text:
        return spoken.withColumn("review", F.coalesce("review", F.lit("")))
    return spoken.filter(F.col("review").isNotNull())


def fill_playtime(df: DataFrame, minutes: str = "author_playtime_forever") -> DataFrame:
    """Missing playtime counts as 0; adds hours and the vote as a number."""
    filled = df.fillna(0, subset=[minutes])
    return filled.withColumns(
        {
            "playtime_hours": F.col(minutes) / 60.0,
            "voted_up_int": F.col("voted_up").cast("int"),
        }
    )


def with_file(df: DataFrame, out: str = "file") -> DataFrame:
    """Adds the file each row was read from."""
    return df.withColumn(out, F.col("_metadata.file_path"))


def file_identity(
    df: DataFrame, file: str = "file", app_id: str = "steam_appid", names: list[str] | None = None
) -> DataFrame:
    """Per file: its most frequent product id, and the most frequent name of the first
    name column that has any value. Files without an id are left out."""
    found = most_frequent(df, [file], app_id, "app_id")
    present = [n for n in (names or NAME_COLUMNS) if n in df.columns]
    for n in present:
        found = found.join(most_frequent(df, [file], n, f"_{n}"), file, "left")
    name: Column = F.coalesce(*[F.col(f"_{n}") for n in present]) if present else F.lit(None)
    return found.select(file, "app_id", name.cast("string").alias("name"))


def accepted_files(identity: DataFrame, themes: DataFrame) -> DataFrame:
    """Files whose product has themes."""
    return identity.join(themes.select("app_id"), "app_id", "left_semi")


def skipped_files(files: DataFrame, identity: DataFrame, themes: DataFrame) -> DataFrame:
    """The other files, each with the reason."""
    known = themes.select("app_id", F.lit(True).alias("_has")).distinct()
    return (
        files.join(identity, "file", "left")
        .join(known, "app_id", "left")
        .filter(F.col("_has").isNull())
        .select(
            "file",
            "app_id",
            F.when(F.col("app_id").isNull(), "no product id")
            .otherwise("product has no themes")
            .alias("reason"),
        )
    )


def own_rows(df: DataFrame, identity: DataFrame, app_id: str = "steam_appid") -> DataFrame:
    """Rows that belong to the product of their file; foreign rows are dropped."""
    own = identity.select(F.col("file").alias("_file"), F.col("app_id").alias("_app"))
    return df.join(own, (df["file"] == own["_file"]) & (df[app_id] == own["_app"])).drop("_file", "_app")


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first source that has it."""
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = rows.groupBy(key).agg(F.min("source_no").alias("source_no"))
    return rows.join(first, [key, "source_no"], "left_semi")
