"""Volume, sentiment and playtime."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewspark.catalogue.binding import (
    APP, LANGUAGE, REVIEWS_SQL, reviews, table,
)
from reviewspark.catalogue.registry import query
from reviewspark.operators.aggregate import counts_by
from reviewspark.plans import explore


def _products(spark, sf):
    return table(spark, sf, "documents").select(
        F.regexp_extract("source", "[0-9]+", 0).try_cast("int").alias("app_id"), "lang", "n_chars"
    )


def _playtime(spark, sf):
    filled = table(spark, sf, "events").select("user_id", "event_type", "value").fillna(0, ["value"])
    return filled.withColumn("hours", F.col("value") / 60.0)


_PLAYTIME_SQL = "playtime AS (SELECT user_id, event_type, coalesce(value, 0) / 60.0 AS hours FROM events)"


@query(f"SELECT {APP} AS app_id, count(*) AS review_count FROM documents GROUP BY 1 "
       "ORDER BY review_count DESC, app_id LIMIT 100")
def volume_per_product(spark, sf):
    return explore.top_volume(_products(spark, sf))


@query(f"SELECT {APP} AS app_id, count(*) AS review_count FROM documents WHERE lang = '{LANGUAGE}' "
       "GROUP BY 1 ORDER BY review_count DESC, app_id LIMIT 100")
def volume_per_product_lang(spark, sf):
    return explore.top_volume(_products(spark, sf).filter(F.col("lang") == LANGUAGE))


@query("""WITH top AS (SELECT o_custkey AS app_id, count(*) AS review_count FROM orders GROUP BY 1
  ORDER BY review_count DESC, app_id LIMIT 100)
SELECT * FROM top ORDER BY review_count, app_id DESC LIMIT 5""")
def top_tail(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("app_id"))
    return explore.tail_of_top(orders)


@query(f"""WITH {REVIEWS_SQL}
SELECT app_id, count(*) AS review_count, sum(voted_up::INT)::BIGINT AS positive,
       (count(*) - sum(voted_up::INT))::BIGINT AS negative, 0::BIGINT AS unvoted,
       round(sum(voted_up::INT) / count(*), 6) AS positive_ratio
FROM reviews WHERE voted_up IS NOT NULL GROUP BY 1 HAVING count(*) >= 10
ORDER BY sum(voted_up::INT) / count(*) DESC, app_id LIMIT 20""")
def positive_ratio_min_reviews(spark, sf):
    voted = reviews(spark, sf).filter(F.col("voted_up").isNotNull())
    return explore.best_liked(voted, least=10).withColumn("positive_ratio", F.round("positive_ratio", 6))


@query(f"""WITH {_PLAYTIME_SQL}
SELECT user_id, count(*) AS n, round(avg(hours), 6) AS mean_hours, round(median(hours), 6) AS median_hours,
       round(quantile_cont(hours, 0.95), 6) AS percentile_95_hours
FROM playtime GROUP BY 1""")
def playtime_stats(spark, sf):
    stats = explore.playtime_stats(_playtime(spark, sf), ["user_id"], "hours")
    names = ["mean_hours", "median_hours", "percentile_95_hours"]
    return stats.withColumns({n: F.round(n, 6) for n in names})


@query("""SELECT least(floor(value), 998)::INT AS hour, count(*) AS n FROM events
WHERE value >= 0 AND value <= 999 GROUP BY 1""")
def playtime_histogram(spark, sf):
    return explore.playtime_histogram(table(spark, sf, "events"), "value")


@query("""SELECT round(avg(value), 6) AS mean_hours, count(value) AS n, round(median(value), 6) AS median_hours
FROM events WHERE value < 1000""")
def playtime_global(spark, sf):
    overall = explore.playtime_overall(table(spark, sf, "events"), "value")
    return overall.withColumns({n: F.round(n, 6) for n in ["mean_hours", "median_hours"]})


@query("""WITH n AS (SELECT l_suppkey AS app_id, count(*) AS review_count FROM lineitem GROUP BY 1)
SELECT app_id, review_count, CASE WHEN review_count > 620 THEN 'large' WHEN review_count >= 580 THEN 'medium'
  ELSE 'small' END AS bucket FROM n""")
def volume_buckets(spark, sf):
    sold = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("app_id"))
    return explore.volume_buckets(sold, medium=580, large=620)


@query("""SELECT event_type AS value, count(*) AS mentions, round(avg(value), 6) AS mean_value
FROM events GROUP BY 1 ORDER BY mentions DESC, 1""")
def value_frequency(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("kind"))
        .agg(F.count(F.lit(1)).alias("mentions"), F.round(F.avg("value"), 6).alias("mean_value"))
        .withColumnRenamed("kind", "value")
        .orderBy(F.desc("mentions"), "value")
    )


@query("""SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers
FROM orders GROUP BY 1 ORDER BY 1""")
def distinct_products(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))
        .orderBy("priority")
    )


@query(f"SELECT DISTINCT {APP} AS app_id, lang FROM documents ORDER BY 1, 2")
def distinct_values(spark, sf):
    return _products(spark, sf).select("app_id", "lang").distinct().orderBy("app_id", "lang")


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {REVIEWS_SQL}
SELECT review_language, round(avg(CASE WHEN voted_up THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_positive,
       count(voted_up) AS voted, count(*) AS n
FROM reviews GROUP BY 1""")
def positive_share_by_language(spark, sf):
    from reviewspark.functions.numbers import positive_share

    return reviews(spark, sf).groupBy("review_language").agg(
        F.round(positive_share(F.col("voted_up")), 6).alias("pct_positive"),
        F.count("voted_up").alias("voted"),
        F.count(F.lit(1)).alias("n"),
    )


@query(f"""WITH p AS (SELECT {APP} AS app_id, e.label - 1 AS topic FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
n AS (SELECT {APP} AS app_id, count(*) AS c FROM documents GROUP BY 1),
f AS (SELECT app_id, count(DISTINCT topic) AS n_topics FROM p GROUP BY 1)
SELECT app_id, CASE WHEN c > 200 THEN 'large' WHEN c >= 50 THEN 'medium' ELSE 'small' END AS bucket, n_topics
FROM f JOIN n USING (app_id) ORDER BY bucket, n_topics DESC, app_id""")
def topics_by_bucket(spark, sf):
    from reviewspark.catalogue.binding import vectors

    labelled = vectors(spark, sf).withColumn("topic", F.col("label") - 1)
    buckets = explore.volume_buckets(_products(spark, sf), medium=50, large=200)
    return explore.topics_by_bucket(labelled, buckets)


@query(f"""WITH p AS (SELECT e.label - 1 AS topic, d.n_chars / 60.0 AS hours, l.quality = 1 AS voted_up
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT topic, count(*) AS n, round(avg(hours), 6) AS avg_playtime,
       round(avg(CASE WHEN voted_up THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_positive
FROM p WHERE topic >= 0 GROUP BY 1""")
def topic_profile(spark, sf):
    from reviewspark.catalogue.binding import vectors

    topics = vectors(spark, sf).select(
        F.col("vec_id").alias("review_id"), (F.col("label") - 1).alias("topic")
    )
    seen = reviews(spark, sf).join(topics, "review_id").withColumn("hours", F.col("votes_up") / 60.0)
    profile = explore.topic_profile(seen, "topic", "hours", "voted_up")
    return profile.withColumns({n: F.round(n, 6) for n in ["avg_playtime", "pct_positive"]})


@query("""WITH w AS (SELECT p_size % 7 - 1 AS topic, unnest(string_split(p_name || ' ' || p_type, ' ')) AS value FROM part),
n AS (SELECT topic, value, count(*) AS n FROM w WHERE topic >= 0 GROUP BY ALL)
SELECT topic, value, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, value)::INT AS rank FROM n
QUALIFY rank <= 3""")
def top_values_per_topic(spark, sf):
    parts = table(spark, sf, "part").select(
        (F.col("p_size") % 7 - 1).alias("topic"),
        F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("genres"),
    )
    return explore.topic_values(parts, "topic", "genres")


@query("""SELECT label AS topic, count(*) AS n FROM embeddings WHERE label - 1 >= 0 GROUP BY 1""")
def drop_outliers(spark, sf):
    kept = table(spark, sf, "embeddings").filter(F.col("label") - 1 >= 0)
    return counts_by(kept.select(F.col("label").alias("topic")), "topic")
