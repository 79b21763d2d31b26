"""Nested product documents: parse, reject, flatten to one row per review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.functions.arrays import field_of_each
from reviewspark.runtime import settle
from reviewspark.schema import RAW_DOCUMENT, REVIEWS


def read_raw(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Documents as text: one per file, or one per line (which Spark can split)."""
    return spark.read.text(path, wholetext=whole_files)


def _parsed(texts: DataFrame, column: str) -> DataFrame:
    """Adds `_doc`; each text is parsed once, whatever is asked about it later."""
    return settle(texts, "_doc", F.from_json(column, RAW_DOCUMENT))


def rejects(texts: DataFrame, column: str = "value") -> DataFrame:
    """Texts that are no document, or whose products report a failure or carry no data."""
    some = F.exists(F.map_values("_doc"), usable)
    return (
        _parsed(texts, column)
        .withColumn(
            "reason",
            F.when(F.col("_doc").isNull(), "not a document").when(
                ~F.coalesce(some, F.lit(False)), "no successful product"
            ),
        )
        .filter(F.col("reason").isNotNull())
        .drop("_doc")
    )


def usable(product: Column) -> Column:
    """Whether a product reports success and carries data."""
    return F.coalesce(product["success"], F.lit(False)) & product["data"].isNotNull()


def products(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per successful product: app_id (the key of the document) and data."""
    return (
        _parsed(texts, column)
        .select(F.explode("_doc").alias("key", "product"))
        .filter(usable(F.col("product")))
        .select(F.col("key").try_cast("bigint").alias("app_id"), F.col("product.data").alias("data"))
    )


def review_totals(parsed: DataFrame) -> DataFrame:
    """Number of reviews each product document carries."""
    n = F.coalesce(F.size("data.review_stats.reviews"), F.lit(0))
    return parsed.select("app_id", F.greatest(n, F.lit(0)).alias("total_num_reviews"))


def flatten(parsed: DataFrame) -> DataFrame:
    """The flat reviews table: product attributes repeated on every review.

    Products without reviews give no row.
    """
    d = F.col("data")
    one = parsed.select(
        d["name"].alias("name"),
        d["steam_appid"].alias("steam_appid"),
        d["required_age"].try_cast("bigint").alias("required_age"),
        d["is_free"].alias("is_free"),
        d["controller_support"].alias("controller_support"),
        d["detailed_description"].alias("detailed_description"),
        d["about_the_game"].alias("about_the_game"),
        d["short_description"].alias("short_description"),
        d["price_overview"]["final_formatted"].alias("price_overview"),
        d["metacritic"]["score"].alias("metacritic_score"),
        field_of_each(d["categories"], "description").alias("categories"),
        field_of_each(d["genres"], "description").alias("genres"),
        d["recommendations"]["total"].alias("recommendations"),
        d["achievements"]["total"].alias("achievements"),
        d["release_date"]["coming_soon"].alias("release_coming_soon"),
        d["release_date"]["date"].alias("release_date"),
        F.explode(d["review_stats"]["reviews"]).alias("r"),
    )
    r, author = F.col("r"), F.col("r.author")
    per_review = {
        "review_language": r["language"],
        "author_steamid": author["steamid"],
        "author_num_games_owned": author["num_games_owned"],
        "author_num_reviews": author["num_reviews"],
        "author_playtime_forever": author["playtime_forever"],
        "author_play_time_last_two_weeks": author["playtime_last_two_weeks"],
        "author_playtime_at_review": author["playtime_at_review"],
        "author_last_played": author["last_played"],
        "review": r["review"],
        "voted_up": r["voted_up"],
        "votes_up": r["votes_up"],
        "votes_funny": r["votes_funny"],
        "weighted_vote_score": r["weighted_vote_score"].try_cast("double"),
    }
    return one.withColumns(per_review).select(*REVIEWS.names)


def catalogue(lists: DataFrame) -> DataFrame:
    """Product list documents (`applist.apps`) as rows in id order."""
    return lists.select(F.inline("applist.apps")).orderBy("appid")


def conversion_summary(reviews: DataFrame, app_id: str = "steam_appid") -> DataFrame:
    """Reviews per product and, with app_id null and is_total 1, of all of them."""
    return (
        reviews.rollup(app_id)
        .agg(F.count(F.lit(1)).alias("review_count"), F.grouping(app_id).cast("int").alias("is_total"))
        .withColumnRenamed(app_id, "app_id")
    )


def manifest(reviews: DataFrame, app_id: str = "steam_appid") -> DataFrame:
    """What was written for each product: rows and when."""
    return reviews.groupBy(F.col(app_id).alias("app_id")).agg(
        F.count(F.lit(1)).alias("total_reviews"), F.current_timestamp().alias("processed_at")
    )
