"""Theme assignment and the reports built on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reviewspark.catalogue.binding import (
    ASSIGNED_SQL, COUNTED_SQL, LANGUAGE, REVIEWS_SQL, THEME_NAME, THEMES_SQL, VECTORS_SQL, percent_sql,
    english_reviews, reviews, table, themes, vectors, voted_reviews,
)
from reviewspark.catalogue.registry import query
from reviewspark.operators import aggregate
from reviewspark.functions.text import tokens
from reviewspark.operators.folding import TopValues, fold_groups, with_themes
from reviewspark.operators.themes import (
    Entries, TermIndex, assign_by_text, nearest_vectors, seed_centroids, seed_weights, vector_centroids,
)
from reviewspark.plans import report
from reviewspark.runtime import cut

_CENTROID_SQL = VECTORS_SQL + """, dims AS (
  SELECT app_id, label AS topic_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM vectors),
means AS (SELECT app_id, topic_id, dim, avg(x) AS x FROM dims GROUP BY ALL)"""
_VECTOR_BEST_SQL = _CENTROID_SQL + """, centroids AS (
  SELECT app_id, topic_id, list(x ORDER BY dim) AS centroid FROM means GROUP BY ALL),
best AS (
  SELECT v.vec_id, v.app_id, c.topic_id, round(list_cosine_similarity(v.embedding, c.centroid), 9) AS similarity
  FROM vectors v JOIN centroids c ON v.app_id = c.app_id
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, topic_id) = 1)"""


def _vector_themes(points):
    seeds = points.select("app_id", F.col("label").alias("topic_id"), "embedding")
    return cut(vector_centroids(seeds))


def _assigned(spark, sf):
    return assign_by_text(english_reviews(spark, sf), themes(spark))


@query("WITH " + _CENTROID_SQL + " SELECT app_id, topic_id, (dim - 1)::INT AS dim, round(x, 6) AS x FROM means")
def theme_centroids(spark, sf):
    points = vectors(spark, sf)
    seeds = points.select("app_id", F.col("label").alias("topic_id"), "embedding")
    return vector_centroids(seeds).select(
        "app_id", "topic_id", F.posexplode("centroid").alias("dim", "x")
    ).withColumn("x", F.round("x", 6))


@query("WITH " + _VECTOR_BEST_SQL + " SELECT vec_id, app_id, topic_id, round(similarity, 6) AS similarity FROM best")
def theme_assignment(spark, sf):
    points = vectors(spark, sf)
    placed = nearest_vectors(points, _vector_themes(points), "embedding", ["app_id"])
    return placed.select("vec_id", "app_id", "topic_id", F.round("similarity", 6).alias("similarity"))


@query("WITH " + ASSIGNED_SQL + """
SELECT app_id, topic_id, term, round(weight, 6) AS weight FROM centroid""")
def seed_term_centroids(spark, sf):
    # The dictionary is tied to the products that occur in the reviews.
    present = reviews(spark, sf).select("app_id").distinct()
    return seed_centroids(themes(spark).join(present, "app_id", "left_semi")).withColumn(
        "weight", F.round("weight", 6)
    )


@query("WITH " + ASSIGNED_SQL + """
SELECT review_id, app_id, topic_id, round(similarity, 6) AS similarity FROM assigned""")
def theme_assignment_text(spark, sf):
    return _assigned(spark, sf).select(
        "review_id", "app_id", "topic_id", F.round("similarity", 6).alias("similarity")
    )


@query("WITH " + COUNTED_SQL + f"""
SELECT c.app_id, c.topic_id, {THEME_NAME} AS theme, review_count, positive, negative, unvoted,
  {percent_sql('positive', '(positive + negative)')} AS like_ratio,
  {percent_sql('negative', '(positive + negative)')} AS dislike_ratio
FROM counted c LEFT JOIN themes t ON t.app_id = c.app_id AND t.topic_id = c.topic_id""")
def theme_report(spark, sf):
    return report.theme_report(english_reviews(spark, sf), themes(spark)).orderBy(
        F.desc("review_count"), "app_id", "topic_id"
    )


@query("WITH " + COUNTED_SQL + f""", filled AS (
  SELECT t.app_id, t.topic_id, t.theme, coalesce(review_count, 0) AS review_count,
         coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, coalesce(unvoted, 0) AS unvoted
  FROM themes t LEFT JOIN counted c ON t.app_id = c.app_id AND t.topic_id = c.topic_id)
SELECT *, {percent_sql('positive', '(positive + negative)')} AS like_ratio,
  {percent_sql('negative', '(positive + negative)')} AS dislike_ratio FROM filled""")
def theme_report_completed(spark, sf):
    counts = report.theme_report(english_reviews(spark, sf), themes(spark))
    return report.completed(counts, themes(spark))


@query("WITH " + _VECTOR_BEST_SQL + f""", voted AS (
  SELECT b.app_id, b.topic_id, l.quality = 1 AS voted_up FROM best b LEFT JOIN labels l ON l.doc_id = b.vec_id),
c AS (SELECT app_id, topic_id, count(*) AS review_count, count(*) FILTER (WHERE voted_up) AS positive,
             count(*) FILTER (WHERE NOT voted_up) AS negative, count(*) FILTER (WHERE voted_up IS NULL) AS unvoted
      FROM voted GROUP BY ALL)
SELECT app_id, topic_id, review_count, positive, negative, unvoted, {percent_sql('positive', '(positive + negative)')} AS like_ratio,
  {percent_sql('negative', '(positive + negative)')} AS dislike_ratio FROM c""")
def theme_report_vectors(spark, sf):
    points = vectors(spark, sf)
    placed = nearest_vectors(points, _vector_themes(points), "embedding", ["app_id"]).select("vec_id", *report.KEYS)
    votes = table(spark, sf, "labels").select(
        F.col("doc_id").alias("vec_id"), (F.col("quality") == 1).alias("voted_up")
    )
    return report.with_ratios(aggregate.sentiment_counts(placed.join(votes, "vec_id", "left"), *report.KEYS))


@query("WITH " + ASSIGNED_SQL + """, placed AS (
  SELECT *, (row_number() OVER (PARTITION BY app_id, topic_id, voted_up ORDER BY review_id) - 1) // 5 AS chunk_no
  FROM assigned)
SELECT app_id, topic_id, voted_up, chunk_no, count(*)::INT AS n,
       string_agg(review, chr(10) || '--' || chr(10) ORDER BY review_id) AS reviews
FROM placed GROUP BY ALL""")
def theme_review_lists(spark, sf):
    assigned = cut(_assigned(spark, sf).select("review_id", *report.KEYS, "voted_up", "review"))
    pages = report.review_pages(assigned, "review_id", "review", 5)
    return pages.select(
        *report.KEYS, "voted_up", "chunk_no",
        F.size("reviews").alias("n"), F.array_join("reviews", "\n--\n").alias("reviews"),
    )


@query("WITH " + COUNTED_SQL + f""", pos AS (
  SELECT app_id, topic_id, voted_up, review, review_id,
    (row_number() OVER (PARTITION BY app_id, topic_id, voted_up ORDER BY review_id) - 1) // 20 AS page FROM assigned),
pages AS (
  SELECT app_id, topic_id, page, count(*) FILTER (WHERE voted_up)::INT AS n_pos, count(*) FILTER (WHERE NOT voted_up)::INT AS n_neg,
    coalesce(md5(string_agg(review, '|' ORDER BY review_id) FILTER (WHERE voted_up)), md5('')) AS pos_hash,
    coalesce(md5(string_agg(review, '|' ORDER BY review_id) FILTER (WHERE NOT voted_up)), md5('')) AS neg_hash,
    coalesce(md5(string_agg(review, '|' ORDER BY review_id) FILTER (WHERE voted_up IS NULL)), md5('')) AS open_hash
  FROM pos GROUP BY ALL)
SELECT c.app_id, {THEME_NAME} AS theme, review_count, page, n_pos, n_neg, pos_hash, neg_hash, open_hash
FROM counted c JOIN pages p USING (app_id, topic_id)
LEFT JOIN themes t ON t.app_id = c.app_id AND t.topic_id = c.topic_id""")
def theme_report_pages(spark, sf):
    assigned = cut(_assigned(spark, sf).select("review_id", *report.KEYS, "voted_up", "review"))
    counts = report.report_of(assigned, themes(spark))
    full = report.paged_report(counts, assigned, "review_id", "review", 20)
    digest = lambda c: F.md5(F.array_join(c, "|"))
    return full.select(
        "app_id", "theme", "review_count", "page",
        F.size("positive_reviews").alias("n_pos"), F.size("negative_reviews").alias("n_neg"),
        digest("positive_reviews").alias("pos_hash"), digest("negative_reviews").alias("neg_hash"),
        digest("unvoted_reviews").alias("open_hash"),
    )


@query("WITH " + COUNTED_SQL + f"""
SELECT c.app_id, c.topic_id, {THEME_NAME} AS theme, review_count, positive, negative, unvoted,
  {percent_sql('positive', '(positive + negative)')} AS like_ratio,
  {percent_sql('negative', '(positive + negative)')} AS dislike_ratio
FROM counted c LEFT JOIN themes t ON t.app_id = c.app_id AND t.topic_id = c.topic_id""")
def partial_final_equivalence(spark, sf):
    partials = report.partial_counts(_assigned(spark, sf), "review_id", 100)
    return report.merged_report(partials, themes(spark))


@query("WITH " + COUNTED_SQL + f"""
SELECT c.app_id, c.topic_id, {THEME_NAME} AS theme, positive AS likes, negative AS dislikes, unvoted
FROM counted c LEFT JOIN themes t ON t.app_id = c.app_id AND t.topic_id = c.topic_id""")
def theme_sentiment_pivot(spark, sf):
    return report.sentiment_pivot(_assigned(spark, sf), themes(spark))


@query("WITH " + ASSIGNED_SQL + """
SELECT app_id, topic_id, review_id, votes_up, review FROM assigned
QUALIFY row_number() OVER (PARTITION BY app_id, topic_id ORDER BY votes_up DESC, review_id) = 1""")
def best_example_per_theme(spark, sf):
    assigned = cut(_assigned(spark, sf).select("review_id", *report.KEYS, "votes_up", "review"))
    return report.best_examples(assigned, "votes_up", "review_id", "review")


@query("WITH " + ASSIGNED_SQL + """
SELECT app_id, topic_id, min(review_id) AS review_id FROM assigned GROUP BY ALL""")
def first_example_per_theme(spark, sf):
    return _assigned(spark, sf).groupBy(*report.KEYS).agg(F.min("review_id").alias("review_id"))


@query("WITH " + ASSIGNED_SQL + """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY app_id, topic_id, voted_up ORDER BY review_id) AS sample_no FROM assigned)
SELECT app_id, topic_id, voted_up, sample_no, review_id,
  CASE WHEN length(review) > 300 THEN substring(review, 1, 300) || '...' ELSE review END AS sample
FROM placed WHERE sample_no <= 5 AND voted_up IS NOT NULL""")
def samples_per_group(spark, sf):
    assigned = cut(_assigned(spark, sf).select("review_id", *report.KEYS, "voted_up", "review"))
    return report.sample_reviews(assigned, "review_id", "review")


@query("WITH " + ASSIGNED_SQL + """
SELECT count(*) AS listed_rows, (SELECT count(*) FROM english) AS source_rows,
       count(*) = (SELECT count(*) FROM english) AS matches FROM assigned""")
def reconcile_rows(spark, sf):
    assigned = cut(_assigned(spark, sf).select("review_id", *report.KEYS, "voted_up", "review"))
    pages = report.review_pages(assigned, "review_id", "review", 50)
    return aggregate.reconcile(pages, "reviews", english_reviews(spark, sf))


@query("WITH " + COUNTED_SQL + f"""
SELECT c.app_id AS steam_appid, {THEME_NAME} AS "Theme", review_count AS "#Reviews", positive AS "Positive",
  negative AS "Negative", {percent_sql('positive', '(positive + negative)')} AS "LikeRatio",
  {percent_sql('negative', '(positive + negative)')} AS "DislikeRatio"
FROM counted c LEFT JOIN themes t ON t.app_id = c.app_id AND t.topic_id = c.topic_id
WHERE c.app_id = 3 ORDER BY review_count DESC, 2 LIMIT 3""")
def report_views(spark, sf):
    from reviewspark.sources.sinks import deliver

    chosen = report.drill_down(report.theme_report(english_reviews(spark, sf), themes(spark)), 3)
    return deliver(chosen).orderBy(F.desc("#Reviews"), "Theme").limit(3)


@query(f"""WITH {REVIEWS_SQL}, {THEMES_SQL},
v AS (SELECT * FROM reviews WHERE review_language = '{LANGUAGE}' AND voted_up IS NOT NULL),
c AS (SELECT app_id, count(*) AS n FROM v GROUP BY 1),
l AS (SELECT app_id, count(*) AS n FROM v WHERE voted_up GROUP BY 1)
SELECT coalesce(c.app_id, l.app_id) AS app_id, round(l.n / c.n * 100, 6) AS pct FROM c FULL JOIN l ON c.app_id = l.app_id""")
def aggregate_alignment(spark, sf):
    votes = voted_reviews(spark, sf).select("app_id", "voted_up")
    counts = aggregate.counts_by(votes, "app_id", name="n")
    likes = aggregate.counts_by(votes.filter("voted_up"), "app_id", name="likes")
    return counts.join(likes, "app_id", "full").select(
        "app_id", F.round(F.col("likes") / F.col("n") * 100, 6).alias("pct")
    )


@query("WITH " + COUNTED_SQL + """
SELECT app_id, topic_id, review_count, positive, negative, unvoted FROM counted""")
def per_product_report(spark, sf):
    """Each product with its themes in a function of its own; a product of more than 100 reviews goes in slices."""

    def count(key, reviews, weights):
        index = TermIndex.of(weights.select(["app_id", "topic_id", "term", "weight"]))
        words = reviews.column("words").combine_chunks()
        topic, _ = index.score(reviews.column("app_id").combine_chunks(), Entries.of_words(words))
        # 0 against, 1 for, 2 without a vote
        vote = reviews.column("voted_up").cast(pa.int8()).fill_null(2).to_numpy()
        topics, of = np.unique(topic, return_inverse=True)
        n = np.bincount(of * 3 + vote, minlength=3 * len(topics)).reshape(-1, 3)
        columns = [[key[0]] * len(topics), topics, n.sum(axis=1), n[:, 1], n[:, 0], n[:, 2]]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["app_id", "topic_id", "review_count", "positive", "negative", "unvoted"])

    rows = english_reviews(spark, sf).select("app_id", "review_id", "voted_up", tokens(F.col("review")).alias("words"))
    parts = with_themes(rows, seed_weights(themes(spark)), "app_id", "review_id", count,
                        "app_id int, topic_id int, review_count long, positive long, negative long, unvoted long", most=100)
    return aggregate.merge_counts(parts, *report.KEYS)


@query("""SELECT lang, n_chars AS value, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE n_chars IS NOT NULL
GROUP BY lang, n_chars QUALIFY dense_rank() OVER (PARTITION BY lang ORDER BY n_chars DESC) <= 5""")
def largest_values_per_language(spark, sf):
    """The five largest lengths of each language with the rows that have them, by an aggregate with a state of its own."""
    rows = table(spark, sf, "documents").select("lang", "n_chars", "doc_id")
    top = fold_groups(rows, ["lang"], ["n_chars", "doc_id"], TopValues("n_chars", "doc_id", 5),
                      "top array<struct<value: bigint, n: bigint, first_id: bigint>>")
    return top.select("lang", F.inline("top"))


@query("""WITH n AS (SELECT text, l.label AS topic FROM documents d JOIN embeddings l ON l.vec_id = d.doc_id),
m AS (SELECT n.topic, d.n_chars FROM n JOIN documents d ON d.text = n.text),
c AS (SELECT topic, count(*) AS mentions FROM n GROUP BY 1),
s AS (SELECT topic, count(*) AS joined_rows, round(avg(n_chars), 6) AS avg_votes_up FROM m GROUP BY 1)
SELECT topic, mentions, joined_rows, avg_votes_up FROM c JOIN s USING (topic)""")
def text_join_fanout(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    topics = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    labelled = docs.join(topics, "doc_id").select("text", "topic")
    # Equal texts are joined as counts, not as every pair of copies.
    left = aggregate.counts_by(labelled, "text", "topic", name="copies")
    right = docs.groupBy("text").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("votes"))
    fanned = left.join(right, "text").groupBy("topic").agg(
        F.sum(F.col("copies") * F.col("rows")).alias("joined_rows"),
        F.sum(F.col("copies") * F.col("votes")).alias("votes"),
    )
    mentions = aggregate.counts_by(labelled, "topic", name="mentions")
    return mentions.join(fanned, "topic").select(
        "topic", "mentions", "joined_rows",
        F.round(F.col("votes") / F.col("joined_rows"), 6).alias("avg_votes_up"),
    )


@query("""WITH c AS (SELECT l_returnflag AS theme, count(*) AS n FROM lineitem GROUP BY 1),
k AS (SELECT DISTINCT l_returnflag AS theme, 'words of ' || l_returnflag AS keywords FROM lineitem),
i AS (SELECT l_linestatus AS topic_id, count(*) AS items FROM lineitem GROUP BY 1),
j AS (SELECT DISTINCT o_orderstatus AS cluster_id FROM orders)
SELECT theme, n, keywords, topic_id, items FROM c JOIN k USING (theme), (SELECT * FROM i JOIN j ON i.topic_id = j.cluster_id)
WHERE (theme = 'N') = (topic_id = 'O')""")
def keyword_join(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    counts = aggregate.counts_by(lines.select(F.col("l_returnflag").alias("theme")), "theme")
    words = counts.select("theme", F.concat(F.lit("words of "), "theme").alias("keywords"))
    items = aggregate.counts_by(lines.select(F.col("l_linestatus").alias("topic_id")), "topic_id", name="items")
    clusters = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("cluster_id")).distinct()
    known = items.join(clusters, items["topic_id"] == clusters["cluster_id"]).drop("cluster_id")
    open_ = F.when(F.col("theme") == "N", "O").otherwise("F")
    return counts.join(words, "theme").withColumn("topic_id", open_).join(known, "topic_id")
