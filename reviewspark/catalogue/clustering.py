"""Clusters that start from the themes, and topics without seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewspark.catalogue.binding import THEMES_SQL, TOKENS, VECTORS_SQL, ENGLISH_SQL, themes, vectors, english_reviews
from reviewspark.catalogue.registry import query
from reviewspark.operators import clusters
from reviewspark.operators.aggregate import mean_vector
from reviewspark.operators.themes import term_vectors, unit_weights
from reviewspark.runtime import cut

_ROUNDS = 2


def _kmeans_sql(keys: list[str], rounds: int, prior: int = 0) -> str:
    """Unrolled rounds; every round moves the centres c0 -> c1 -> ..., with `prior` points at the seeds c0."""
    k = "".join(f"{x}, " for x in keys)
    on = " AND ".join([f"v.{x} = c.{x}" for x in keys] or ["true"])
    sql = VECTORS_SQL + f""", d AS (SELECT {k}label AS topic_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM vectors),
m AS (SELECT {k}topic_id, dim, avg(x) AS x FROM d GROUP BY ALL),
c0 AS (SELECT {k}topic_id, list(x ORDER BY dim) AS c FROM m GROUP BY ALL)"""
    for i in range(rounds + 1):
        sql += f""", p{i} AS (SELECT v.vec_id, v.app_id, v.embedding, c.topic_id FROM vectors v JOIN c{i} c ON {on}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(embedding, c.c) ** 2, 9), topic_id) = 1),
d{i} AS (SELECT {k}topic_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM p{i}),
z{i} AS (SELECT {k}topic_id, dim, sum(x) AS s, count(*) AS n FROM d{i} GROUP BY ALL),
m{i} AS (SELECT {k}topic_id, dim, {f"(s + {prior} * m.x) / (n + {prior})" if prior else "s / n"} AS x
  FROM z{i} {f"JOIN m USING ({k}topic_id, dim)" if prior else ""}),
n{i} AS (SELECT {k}topic_id, list(x ORDER BY dim) AS c FROM m{i} GROUP BY ALL),
c{i + 1} AS (SELECT {k}topic_id, coalesce(n.c, o.c) AS c FROM c{0 if prior else i} o LEFT JOIN n{i} n USING ({k}topic_id))"""
    return sql


def _seeds(points, keys):
    seeds = points.select(*keys, F.col("label").alias("topic_id"), "embedding")
    return mean_vector(seeds, [*keys, "topic_id"], "embedding")


@query("WITH " + _kmeans_sql([], _ROUNDS) + f" SELECT vec_id, topic_id FROM p{_ROUNDS}")
def seeded_kmeans(spark, sf):
    points = vectors(spark, sf)
    centres = clusters.seeded_kmeans(points, _seeds(points, []), [], "embedding", _ROUNDS)
    return clusters.predict(points, centres, [], "embedding").select("vec_id", "topic_id")


@query("WITH " + _kmeans_sql(["app_id"], _ROUNDS) + f" SELECT vec_id, app_id, topic_id FROM p{_ROUNDS}")
def per_product_fit(spark, sf):
    points = vectors(spark, sf)
    centres = clusters.seeded_kmeans(points, _seeds(points, ["app_id"]), ["app_id"], "embedding", _ROUNDS)
    return clusters.predict(points, centres, ["app_id"], "embedding").select("vec_id", "app_id", "topic_id")


_PRIOR = 40


@query("WITH " + _kmeans_sql(["app_id"], _ROUNDS, _PRIOR) + f" SELECT vec_id, app_id, topic_id FROM p{_ROUNDS}")
def guided_kmeans(spark, sf):
    """Clusters per product that their seeds guide in every round."""
    points = vectors(spark, sf)
    centres = clusters.seeded_kmeans(points, _seeds(points, ["app_id"]), ["app_id"], "embedding", _ROUNDS, prior=_PRIOR)
    return clusters.predict(points, centres, ["app_id"], "embedding").select("vec_id", "app_id", "topic_id")


def _text_kmeans_sql(rounds: int, prior: int = 0) -> str:
    sql = ENGLISH_SQL + ", " + THEMES_SQL + f""",
rt AS (SELECT app_id, review_id, term, count(*) AS tf FROM (
  SELECT app_id, review_id, unnest({TOKENS.format('review')}) AS term FROM english) GROUP BY ALL),
rl AS (SELECT review_id, sqrt(sum(tf * tf)) AS len FROM rt GROUP BY 1),
x AS (SELECT app_id, review_id, term, tf / len AS w FROM rt JOIN rl USING (review_id)),
st AS (SELECT app_id, topic_id, term, count(*) AS tf FROM (
  SELECT app_id, topic_id, unnest({TOKENS.format("array_to_string(seeds, ' ')")}) AS term FROM themes WHERE len(seeds) > 0) GROUP BY ALL),
sl AS (SELECT app_id, topic_id, sqrt(sum(tf * tf)) AS len FROM st GROUP BY ALL),
c0 AS (SELECT app_id, topic_id, term, tf / len AS w FROM st JOIN sl USING (app_id, topic_id))"""
    for i in range(rounds + 1):
        sql += f""", l{i} AS (SELECT app_id, topic_id, sum(w * w) AS c2 FROM c{i} GROUP BY ALL),
dot{i} AS (SELECT x.review_id, c.topic_id, sum(x.w * c.w) AS xc FROM x JOIN c{i} c ON x.app_id = c.app_id AND x.term = c.term GROUP BY ALL),
p{i} AS (SELECT v.app_id, v.review_id, l.topic_id FROM english v JOIN l{i} l ON v.app_id = l.app_id
  LEFT JOIN dot{i} d ON d.review_id = v.review_id AND d.topic_id = l.topic_id
  QUALIFY row_number() OVER (PARTITION BY v.review_id ORDER BY round(c2 - 2 * coalesce(xc, 0), 9), l.topic_id) = 1),
z{i} AS (SELECT app_id, topic_id, count(*) AS n FROM p{i} GROUP BY ALL)"""
        sql += f""",
c{i + 1} AS (
  SELECT app_id, topic_id, term, sum(t) / (coalesce(any_value(n), 0) + {prior}) AS w FROM (
    SELECT x.app_id, p.topic_id, term, w AS t FROM x JOIN p{i} p USING (review_id)
    UNION ALL SELECT app_id, topic_id, term, w * {prior} FROM c0) LEFT JOIN z{i} z USING (app_id, topic_id) GROUP BY ALL)""" if prior else f""",
c{i + 1} AS (
  SELECT x.app_id, p.topic_id, term, sum(w) / any_value(n) AS w FROM x JOIN p{i} p USING (review_id)
    JOIN z{i} z ON z.app_id = x.app_id AND z.topic_id = p.topic_id GROUP BY ALL
  UNION ALL SELECT c.* FROM c{i} c ANTI JOIN z{i} z ON c.app_id = z.app_id AND c.topic_id = z.topic_id)"""
    return sql


@query("WITH " + _text_kmeans_sql(_ROUNDS) + f"""
SELECT v.app_id, v.review_id, coalesce(p.topic_id, 0) AS topic_id FROM english v LEFT JOIN p{_ROUNDS} p USING (review_id)""")
def seeded_text_kmeans(spark, sf):
    docs, seeds = _weighted_texts(spark, sf)
    _, labels = clusters.seeded_text_kmeans(docs, seeds, "review_id", _ROUNDS)
    return labels


def _weighted_texts(spark, sf):
    """Reviews and themes as unit vectors of their words."""
    texts = english_reviews(spark, sf).select("app_id", "review_id", "review")
    docs = cut(unit_weights(term_vectors(texts, "review"), "terms", "weights").select("app_id", "review_id", "weights"))
    words = themes(spark).filter(F.size("seeds") > 0).withColumn("seed", F.array_join("seeds", " "))
    return docs, unit_weights(term_vectors(words, "seed"), "terms", "weights").select("app_id", "topic_id", F.inline("weights"))


@query("WITH " + _text_kmeans_sql(_ROUNDS, 5) + f"""
SELECT v.app_id, v.review_id, coalesce(p.topic_id, 0) AS topic_id FROM english v LEFT JOIN p{_ROUNDS} p USING (review_id)""")
def guided_text_topics(spark, sf):
    """Topics of the reviews that the themes' words guide in every round: each theme counts as five reviews of its words."""
    docs, seeds = _weighted_texts(spark, sf)
    _, labels = clusters.seeded_text_kmeans(docs, seeds, "review_id", _ROUNDS, prior=5)
    return labels


@query()
def topics_unsupervised(spark, sf):
    found = clusters.free_topics(vectors(spark, sf), "vec_id", "embedding", topics=8)
    return found.select("vec_id", "topic", F.round("distance", 6).alias("distance"))
