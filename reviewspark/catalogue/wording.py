"""Keywords, sparse vectors and plugged-in functions."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from reviewspark.catalogue.binding import (
    LABELLED_SQL, STOP_SQL, STOP_WORDS, THEMES_SQL, TOKENS, ENGLISH_SQL,
    documents, english_reviews, labelled_texts, themes,
)
from reviewspark.catalogue.registry import query
from reviewspark.operators import keywords
from reviewspark.operators import themes as themes_op
from reviewspark.operators.clusters import representatives
from reviewspark.operators.embedding import assign_embedded
from reviewspark.operators.themes import assign_vectors, pack_vectors
from reviewspark.operators.aggregate import counts_by, mean_vector


@query(f"""WITH t AS (SELECT doc_id, CAST('0x' || substring(md5(term), 1, 8) AS BIGINT) % 262144 AS b
  FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) WHERE term NOT IN {STOP_SQL}),
n AS (SELECT doc_id, b, count(*) AS tf FROM t GROUP BY ALL)
SELECT doc_id, count(b)::INT AS n_buckets, min(b) AS lowest, coalesce(round(sum(tf) / sqrt(sum(tf * tf)), 6), 0) AS total
FROM documents LEFT JOIN n USING (doc_id) GROUP BY 1""")
def hashed_vectors(spark, sf):
    hashed = themes_op.hashed_vectors(documents(spark, sf).select("doc_id", "text"), "text", stop_words=STOP_WORDS)
    weights = F.col("buckets.weight")
    return hashed.select(
        "doc_id",
        F.size("buckets").alias("n_buckets"),
        F.array_min("buckets.term").alias("lowest"),
        F.round(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


# The queries weigh the most frequent terms only, as they are defined.
VOCABULARY = 5000
_TFIDF_SQL = LABELLED_SQL + f""", words AS (
  SELECT topic, doc_id, list_filter({TOKENS.format('text')}, lambda w: w NOT IN {STOP_SQL}) AS w FROM labelled),
grams AS (
  SELECT topic, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM words),
tf AS (SELECT topic, doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocabulary AS (SELECT term, sum(tf) AS uses, count(*) AS df FROM tf GROUP BY 1 ORDER BY uses DESC, term LIMIT {VOCABULARY}),
w AS (SELECT topic, doc_id, term, tf * (ln((1 + (SELECT count(*) FROM labelled)) / (1 + df)) + 1) AS w FROM tf JOIN vocabulary USING (term)),
lengths AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM w GROUP BY 1),
sizes AS (SELECT topic, count(*) AS n FROM labelled GROUP BY 1),
tfidf AS (SELECT topic, term, round(sum(w / len) / any_value(n), 9) AS weight
  FROM w JOIN lengths USING (doc_id) JOIN sizes USING (topic) GROUP BY ALL),
tfidf_top AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term)::INT AS rank
  FROM tfidf QUALIFY rank <= 10)"""


@query("WITH " + _TFIDF_SQL + " SELECT topic, term, round(weight, 6) AS weight, rank FROM tfidf_top")
def tfidf_top_terms(spark, sf):
    docs = labelled_texts(spark, sf).select("topic", "doc_id", "text")
    weights = keywords.tfidf_weights(docs, "topic", "doc_id", "text", vocabulary=VOCABULARY, stop_words=STOP_WORDS)
    return keywords.top_terms(weights, ["topic"]).withColumn("weight", F.round("weight", 6))


def _class_sql(source: str, group: str) -> str:
    return f"""uses AS (
  SELECT g, term, count(*) AS tf FROM (SELECT {group} AS g, unnest({TOKENS.format('text')}) AS term FROM {source})
  WHERE term NOT IN {STOP_SQL} GROUP BY ALL),
per_group AS (SELECT g, sum(tf) AS words FROM uses GROUP BY 1),
per_term AS (SELECT term, sum(tf) AS uses FROM uses GROUP BY 1),
class_tfidf AS (SELECT g, term, round(tf / words * ln(1 + (SELECT avg(words) FROM per_group) / per_term.uses), 9) AS weight
  FROM uses JOIN per_group USING (g) JOIN per_term USING (term))"""


@query(f"""WITH {_class_sql('documents', 'lang')}
SELECT g AS lang, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY g ORDER BY weight DESC, term)::INT AS rank
FROM class_tfidf QUALIFY rank <= 10""")
def class_tfidf_terms(spark, sf):
    weights = keywords.class_tfidf_weights(documents(spark, sf).select("lang", "text"), "lang", "text", STOP_WORDS)
    return keywords.top_terms(weights, ["lang"]).withColumn("weight", F.round("weight", 6))


_TOPIC_TOP_SQL = LABELLED_SQL + ", " + _class_sql("labelled", "topic") + """, top AS (
  SELECT g AS topic, term, weight, row_number() OVER (PARTITION BY g ORDER BY weight DESC, term)::INT AS rank
  FROM class_tfidf QUALIFY rank <= {0})"""


@query("WITH " + _TOPIC_TOP_SQL.replace("{0}", "10") + """, n AS (SELECT topic, count(*) AS n FROM labelled GROUP BY 1)
SELECT topic, n, string_agg(term, ', ' ORDER BY rank) AS top_keywords FROM top JOIN n USING (topic) GROUP BY ALL""")
def topic_table(spark, sf):
    docs = labelled_texts(spark, sf)
    weights = keywords.class_tfidf_weights(docs.select("topic", "text"), "topic", "text", STOP_WORDS)
    words = keywords.keyword_text(keywords.top_terms(weights, ["topic"]), ["topic"])
    return counts_by(docs, "topic").join(words, "topic")


_CENTRE_SQL = """dims AS (SELECT topic, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM labelled),
means AS (SELECT topic, dim, avg(x) AS x FROM dims GROUP BY ALL),
centres AS (SELECT topic, list(x ORDER BY dim) AS centre FROM means GROUP BY 1)"""


@query("WITH " + LABELLED_SQL + ", " + _CENTRE_SQL + """
SELECT topic, doc_id, round(list_cosine_similarity(embedding, centre), 6) AS similarity,
  row_number() OVER (PARTITION BY topic ORDER BY round(list_cosine_similarity(embedding, centre), 9) DESC, doc_id)::INT AS rank,
  replace(text, chr(10), ' ') AS shown
FROM labelled JOIN centres USING (topic) QUALIFY rank <= 3""")
def representative_docs(spark, sf):
    docs = labelled_texts(spark, sf)
    centres = mean_vector(docs, ["topic"], "embedding").withColumn("topic_id", F.lit(0))
    near = assign_vectors(
        docs.select("topic", "doc_id", "embedding"), pack_vectors(centres, ["topic"]), "embedding", ["topic"]
    )
    picked = representatives(near.select("topic", "doc_id", "similarity"), "topic", "doc_id", "similarity")
    # Only the picked documents bring their text along.
    return picked.join(documents(spark, sf).select("doc_id", "text"), "doc_id").select(
        "topic", "doc_id", F.round("similarity", 6).alias("similarity"), "rank",
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("shown"),
    )


@query("WITH " + _TOPIC_TOP_SQL.replace("{0}", "30") + ", " + _CENTRE_SQL + f""",
used AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM labelled)
  WHERE term IN (SELECT term FROM top)),
at_dims AS (SELECT term, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM used JOIN labelled USING (doc_id)),
at_means AS (SELECT term, dim, avg(x) AS x FROM at_dims GROUP BY ALL),
spots AS (SELECT term, list(x ORDER BY dim) AS spot FROM at_means GROUP BY 1),
scored AS (SELECT topic, term, round(list_cosine_similarity(spot, centre), 9) AS weight FROM top JOIN spots USING (term) JOIN centres USING (topic))
SELECT topic, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term)::INT AS rank
FROM scored QUALIFY rank <= 10""")
def keyword_rerank(spark, sf):
    docs = labelled_texts(spark, sf).select("topic", "doc_id", "text", "embedding")
    weights = keywords.class_tfidf_weights(docs.select("topic", "text"), "topic", "text", STOP_WORDS)
    candidates = keywords.top_terms(weights, ["topic"], 30)
    ranked = keywords.rerank_terms(candidates, docs, "topic", "doc_id", "text", "embedding", STOP_WORDS)
    return ranked.withColumn("weight", F.round("weight", 6))


def _letters():
    """A stand-in for a sentence model: how often each letter occurs."""

    def model(texts):
        counted = (Counter(t.lower()) for t in texts)
        return [[float(c[chr(i)]) for i in range(97, 123)] for c in counted]

    return model


_LETTERS = "list_transform(range(97, 123), lambda i: (length(lower({0})) - length(replace(lower({0}), chr(i::INT), '')))::DOUBLE)"


@query(f"""WITH {ENGLISH_SQL}, {THEMES_SQL},
seeds AS (SELECT app_id, topic_id, unnest(seeds) AS seed FROM themes),
seed_vec AS (SELECT app_id, topic_id, {_LETTERS.format('seed')} AS v FROM seeds),
seed_dims AS (SELECT app_id, topic_id, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM seed_vec),
means AS (SELECT app_id, topic_id, dim, avg(x) AS x FROM seed_dims GROUP BY ALL),
centroids AS (SELECT app_id, topic_id, list(x ORDER BY dim) AS c FROM means GROUP BY ALL),
vec AS (SELECT review_id, app_id, {_LETTERS.format('review')} AS v FROM english),
scored AS (SELECT review_id, topic_id, round(coalesce(nullif(list_cosine_similarity(v, c), 'nan'::DOUBLE), 0), 9) AS s
  FROM vec JOIN centroids USING (app_id)),
best AS (SELECT review_id, topic_id, s FROM scored QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY s DESC, topic_id) = 1)
SELECT review_id, app_id, coalesce(topic_id, 0) AS topic_id, round(coalesce(s, 0), 6) AS similarity
FROM english LEFT JOIN best USING (review_id)""")
def embedded_assignment(spark, sf):
    placed = assign_embedded(english_reviews(spark, sf).select("review_id", "app_id", "review"), themes(spark), _letters)
    return placed.select("review_id", "app_id", "topic_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS line_breaks FROM documents")
def partition_function(spark, sf):
    def count_breaks(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "line_breaks": pdf["text"].str.count("\n").astype("int64")})

    return documents(spark, sf).select("doc_id", "text").mapInPandas(count_breaks, "doc_id long, line_breaks long")


@query("""SELECT lang, count(*) AS n, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS line_breaks FROM documents GROUP BY 1""")
def custom_aggregate(spark, sf):
    # Each batch gives one partial row per language; Spark adds the partials up.
    def partials(batches):
        for pdf in batches:
            breaks = pdf.assign(line_breaks=pdf["text"].str.count("\n"))
            yield breaks.groupby("lang", as_index=False).agg(n=("text", "size"), line_breaks=("line_breaks", "sum"))

    parts = documents(spark, sf).select("lang", "text").mapInPandas(partials, "lang string, n long, line_breaks long")
    return parts.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("line_breaks").alias("line_breaks"))
