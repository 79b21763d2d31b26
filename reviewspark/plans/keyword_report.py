"""Themes with their keywords, best example and a short text about it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.numbers import percent_text
from reviewspark.operators.aggregate import sentiment_counts
from reviewspark.operators.keywords import keyword_text, tfidf_weights, top_terms
from reviewspark.operators.ranking import best_row
from reviewspark.operators.summaries import Summariser, or_beginning, summary_column
from reviewspark.runtime import settle


def keyword_report(
    assigned: DataFrame, names: DataFrame, topic: str, key: str, votes: str, text: str,
    make: Callable[[], Summariser] | None = None, stop_words: Iterable[str] = (), vocabulary: int | None = None,
) -> DataFrame:
    """Per topic: name, reviews, like ratio, top keywords, best example and its summary.

    All of them come from all reviews. `names` holds the topic and its theme; `vocabulary`
    limits the keywords to the most frequent terms.
    """
    counts = sentiment_counts(assigned, topic)
    weights = tfidf_weights(assigned, topic, key, text, vocabulary, stop_words)
    keywords = keyword_text(top_terms(weights, [topic]), [topic])
    examples = best_row(
        assigned.select(topic, key, votes, text), [topic], [F.desc(votes), F.asc(key)], key, [text]
    ).select(topic, F.col(text).alias("example"))
    told = settle(examples, "_s", summary_column(F.col("example"), make)) if make is None else (
        examples.withColumn("_s", summary_column(F.col("example"), make)))
    told = told.select(
        topic, "example", or_beginning(F.col("_s.summary"), F.col("example")).alias("summary")
    )
    return (
        counts.join(names, topic, "left")
        .join(keywords, topic, "left")
        .join(told, topic, "left")
        .select(
            topic,
            F.coalesce("theme", F.lit("Other")).alias("theme"),
            "review_count",
            percent_text(F.col("positive"), F.col("positive") + F.col("negative")).alias("like_ratio"),
            "top_keywords",
            "example",
            "summary",
        )
    )
