"""The test tables seen as reviews, votes, themes and vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.runtime import deal_out
from reviewspark.sources.reviews import usable_reviews
from reviewspark.sources.themes import parse_themes

LANGUAGE = "en"

# Function words of the test language, left out of keyword queries.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was",
              "on", "with", "be", "by", "as", "this", "are", "at", "from"]

# A hand-written dictionary. Products 16 to 19 have no themes; one theme has no seeds.
_EVEN = {
    "flow": ["thing", "thion", "than thou"],
    "form": ["thre", "thnt", "thed", "rewh"],
    "sound": ["erin", "erhe eron", "orre"],
    "place": ["thatin", "inoran", "anea"],
}
_ODD = {
    "pace": ["thon", "thhe", "thha"],
    "tone": ["thor", "thea thes", "ered"],
    "unsaid": [],
    "depth": ["thly", "thti", "thing"],
    "ending": ["ononst", "hehely", "orantion", "eran"],
}
THEMES = {str(app): (_ODD if app % 2 else _EVEN) for app in range(16)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents; texts are worked on at length, so those of a small file are dealt out first."""
    return deal_out(table(spark, sf, "documents"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as reviews: product out of `source`, votes out of `labels`."""
    docs = documents(spark, sf).select(
        F.regexp_extract("source", "[0-9]+", 0).try_cast("int").alias("app_id"),
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review"),
        F.col("lang").alias("review_language"),
        F.col("n_chars").alias("votes_up"),
    )
    votes = table(spark, sf, "labels").select(
        F.col("doc_id").alias("review_id"), (F.col("quality") == 1).alias("voted_up")
    )
    return docs.join(votes, "review_id", "left")


def english_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews in the report language, with a vote or without."""
    return usable_reviews(reviews(spark, sf), LANGUAGE)


def voted_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """English reviews that carry a vote, for queries about votes alone."""
    return english_reviews(spark, sf).filter(F.col("voted_up").isNotNull())


def themes(spark: SparkSession) -> DataFrame:
    return parse_themes(spark.range(1).select(F.lit(json.dumps(THEMES)).alias("value")))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the product of the document it belongs to."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"),
        F.regexp_extract("source", "[0-9]+", 0).try_cast("int").alias("app_id"),
    )
    return deal_out(table(spark, sf, "embeddings")).join(docs, "vec_id")


def labelled_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a vector; the label of the vector is their topic."""
    return documents(spark, sf).join(
        table(spark, sf, "embeddings").select(
            F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"), "embedding"
        ),
        "doc_id",
    )


# The same views for the SQL side. Each is the body of a WITH clause.
APP = "CAST(regexp_extract(source, '[0-9]+') AS INTEGER)"
REVIEWS_SQL = f"""reviews AS (
  SELECT {APP} AS app_id, d.doc_id AS review_id, d.text AS review, d.lang AS review_language,
         d.n_chars AS votes_up, l.quality = 1 AS voted_up
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ENGLISH_SQL = REVIEWS_SQL + f""", english AS (
  SELECT * FROM reviews WHERE review_language = '{LANGUAGE}' AND review IS NOT NULL)"""
VOTED_SQL = ENGLISH_SQL + ", voted AS (SELECT * FROM english WHERE voted_up IS NOT NULL)"
VECTORS_SQL = f"""vectors AS (
  SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS embedding, e.label, {APP} AS app_id
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""
LABELLED_SQL = """labelled AS (
  SELECT d.doc_id, d.text, e.label AS topic, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"""
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def _themes_sql() -> str:
    rows = []
    for app, named in THEMES.items():
        for i, (theme, seeds) in enumerate(named.items()):
            listed = ", ".join(f"'{s}'" for s in seeds)
            rows.append(f"({app}, {i}, '{theme}', CAST([{listed}] AS VARCHAR[]))")
    return "themes AS (SELECT * FROM (VALUES " + ",\n ".join(rows) + ") t(app_id, topic_id, theme, seeds))"


THEMES_SQL = _themes_sql()

# English reviews -> assigned(review_id, app_id, topic_id, similarity, ...)
ASSIGNED_SQL = (
    ENGLISH_SQL
    + ", "
    + THEMES_SQL
    + f""", seeds AS (
  SELECT app_id, topic_id, unnest(seeds) AS seed, generate_subscripts(seeds, 1) AS seed_no FROM themes),
n_seeds AS (SELECT app_id, topic_id, count(*) AS n FROM seeds WHERE seed <> '' GROUP BY ALL),
seed_tf AS (
  SELECT app_id, topic_id, seed_no, term, count(*) AS tf
  FROM (SELECT app_id, topic_id, seed_no, unnest({TOKENS.format('seed')}) AS term FROM seeds)
  GROUP BY ALL),
seed_norm AS (SELECT app_id, topic_id, seed_no, sqrt(sum(tf * tf)) AS len FROM seed_tf GROUP BY ALL),
centroid AS (
  SELECT app_id, topic_id, term, sum(tf / len) / any_value(n) AS weight
  FROM seed_tf JOIN seed_norm USING (app_id, topic_id, seed_no) JOIN n_seeds USING (app_id, topic_id)
  GROUP BY app_id, topic_id, term),
theme_norm AS (SELECT app_id, topic_id, sqrt(sum(weight * weight)) AS len FROM centroid GROUP BY ALL),
review_tf AS (
  SELECT app_id, review_id, term, count(*) AS tf
  FROM (SELECT app_id, review_id, unnest({TOKENS.format('review')}) AS term FROM english)
  GROUP BY ALL),
review_norm AS (SELECT review_id, sqrt(sum(tf * tf)) AS len FROM review_tf GROUP BY ALL),
dots AS (
  SELECT r.review_id, c.topic_id, sum(r.tf * c.weight) AS dot
  FROM review_tf r JOIN centroid c ON r.app_id = c.app_id AND r.term = c.term GROUP BY ALL),
scored AS (
  SELECT v.review_id, t.topic_id, coalesce(round(d.dot / (rn.len * tn.len), 9), 0) AS similarity
  FROM english v JOIN themes t ON v.app_id = t.app_id
  LEFT JOIN dots d ON d.review_id = v.review_id AND d.topic_id = t.topic_id
  LEFT JOIN review_norm rn ON rn.review_id = v.review_id
  LEFT JOIN theme_norm tn ON tn.app_id = t.app_id AND tn.topic_id = t.topic_id),
best AS (
  SELECT review_id, topic_id, similarity FROM scored
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY similarity DESC, topic_id) = 1),
assigned AS (
  SELECT v.*, coalesce(b.topic_id, 0) AS topic_id, coalesce(b.similarity, 0) AS similarity
  FROM english v LEFT JOIN best b USING (review_id))"""
)
COUNTED_SQL = (
    ASSIGNED_SQL
    + """, counted AS (
  SELECT app_id, topic_id, count(*) AS review_count, count(*) FILTER (WHERE voted_up) AS positive,
         count(*) FILTER (WHERE NOT voted_up) AS negative, count(*) FILTER (WHERE voted_up IS NULL) AS unvoted
  FROM assigned GROUP BY ALL)"""
)
THEME_NAME = "coalesce(t.theme, 'Unknown Theme ' || c.topic_id)"


def percent_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN printf('%.1f%%', {part} * 100.0 / {whole}) ELSE '0.0%' END"
