"""The theme dictionary: which themes a product has and the seed words of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.schema import THEME_FILE


def parse_themes(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON text -> app_id, topic_id, theme, seeds; topic_id is the position in the file."""
    products = texts.select(F.from_json(column, THEME_FILE).alias("m")).select(
        F.explode("m").alias("app", "themes")
    )
    return products.select(
        F.col("app").cast("int").alias("app_id"),
        F.posexplode("themes").alias("topic_id", "theme", "seeds"),
    )


def read_themes(spark: SparkSession, path: str) -> DataFrame:
    return parse_themes(spark.read.text(path, wholetext=True))


def theme_names(measures: DataFrame, themes: DataFrame) -> DataFrame:
    """Adds `theme`, with a placeholder for topics the dictionary does not have."""
    named = measures.join(themes.select("app_id", "topic_id", "theme"), ["app_id", "topic_id"], "left")
    unknown = F.concat(F.lit("Unknown Theme "), F.col("topic_id").cast("string"))
    return named.withColumn("theme", F.coalesce("theme", unknown))
