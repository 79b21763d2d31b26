"""The theme report: per product and theme how many reviews, how many like it, and which."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.numbers import percent_text
from reviewspark.functions.text import preview
from reviewspark.operators.aggregate import complete, merge_counts, sentiment_counts
from reviewspark.operators.ranking import best_row, chunk_lists, chunk_numbers, first_rows
from reviewspark.operators.themes import assign_by_text
from reviewspark.sources.themes import theme_names

KEYS = ["app_id", "topic_id"]


def with_ratios(counts: DataFrame) -> DataFrame:
    """Shares of the votes; reviews without a vote are in neither."""
    votes = F.col("positive") + F.col("negative")
    return counts.withColumns(
        {
            "like_ratio": percent_text(F.col("positive"), votes),
            "dislike_ratio": percent_text(F.col("negative"), votes),
        }
    )


def report_of(assigned: DataFrame, themes: DataFrame) -> DataFrame:
    """Counts and ratios per theme that has reviews."""
    return with_ratios(theme_names(sentiment_counts(assigned, *KEYS), themes))


def theme_report(
    reviews: DataFrame, themes: DataFrame, text: str = "review", stop_words: Iterable[str] = ()
) -> DataFrame:
    """One lazy plan from the reviews to the report; only partial counts are shuffled."""
    return report_of(assign_by_text(reviews, themes, text, stop_words), themes)


def completed(counts: DataFrame, themes: DataFrame) -> DataFrame:
    """Every theme of the dictionary, those without reviews with 0."""
    names = ["review_count", "positive", "negative", "unvoted"]
    domain = themes.select(*KEYS, "theme")
    return with_ratios(complete(domain, counts.select(*KEYS, *names), KEYS, names))


def partial_counts(assigned: DataFrame, order: str, rows: int) -> DataFrame:
    """Counts per theme and slice of the input, to be merged later."""
    return sentiment_counts(
        assigned.withColumn("part_no", F.floor(F.col(order) / rows)), "part_no", *KEYS
    )


def merged_report(partials: DataFrame, themes: DataFrame) -> DataFrame:
    return with_ratios(theme_names(merge_counts(partials, *KEYS), themes))


def review_pages(assigned: DataFrame, order: str, text: str, k: int) -> DataFrame:
    """The reviews of each theme and side in pages of at most k.

    A page is one row with one list; all pages in order are the whole list, however
    large the theme is. Reviews without a vote are a side of their own (`voted_up` null),
    so the pages hold what the counts count.
    """
    return chunk_lists(assigned, [*KEYS, "voted_up"], order, text, k, out="reviews")


def paged_report(report: DataFrame, assigned: DataFrame, order: str, text: str, k: int) -> DataFrame:
    """Report rows with their lists: page i of a theme holds its i-th k positive, negative and
    unvoted reviews.

    All sides are laid out in one pass, so a text is shuffled twice: to be numbered and
    to join its page.
    """
    votes = assigned.filter(F.col(text).isNotNull())
    entry = F.struct("row_no", F.col(text).alias("t"))
    side = lambda c: F.sort_array(F.collect_list(F.when(c, entry)))["t"]
    lists = (
        chunk_numbers(votes, [*KEYS, "voted_up"], order, k)
        .groupBy(*KEYS, F.col("chunk_no").alias("page"))
        .agg(
            side(F.col("voted_up")).alias("positive_reviews"),
            side(~F.col("voted_up")).alias("negative_reviews"),
            side(F.col("voted_up").isNull()).alias("unvoted_reviews"),
        )
    )
    none = F.array().cast("array<string>")
    filled = {n: F.coalesce(n, none) for n in ("positive_reviews", "negative_reviews", "unvoted_reviews")}
    return report.join(lists, KEYS, "left").withColumns({"page": F.coalesce("page", F.lit(0)), **filled})


def sample_reviews(assigned: DataFrame, order: str, text: str, n: int = 5, most: int = 300) -> DataFrame:
    """The first n reviews of each theme and side, cut to `most` characters."""
    rows = assigned.filter(F.col("voted_up").isNotNull() & F.col(text).isNotNull())
    picked = first_rows(rows, [*KEYS, "voted_up"], order, n, out="sample_no")
    return picked.select(
        *KEYS, "voted_up", "sample_no", order, preview(F.col(text), most).alias("sample")
    )


def best_examples(assigned: DataFrame, votes: str, key: str, text: str) -> DataFrame:
    """The review with the most votes per theme, the first one on a tie."""
    rows = assigned.select(*KEYS, key, votes, text)
    return best_row(rows, KEYS, [F.desc(votes), F.asc(key)], key, [text])


def drill_down(report: DataFrame, app_id: int, theme: str | None = None) -> DataFrame:
    """One product, and one of its themes."""
    chosen = report.filter(F.col("app_id") == app_id)
    return chosen if theme is None else chosen.filter(F.col("theme") == theme)


def sentiment_pivot(assigned: DataFrame, themes: DataFrame) -> DataFrame:
    """Positive, negative and unvoted reviews per theme side by side."""
    sides = ["likes", "dislikes", "unvoted"]
    side = F.when(F.col("voted_up"), "likes").when(~F.col("voted_up"), "dislikes").otherwise("unvoted")
    wide = (
        assigned.withColumn("sentiment", side)
        .groupBy(*KEYS)
        .pivot("sentiment", sides)
        .count()
        .fillna(0, subset=sides)
    )
    return theme_names(wide, themes)
