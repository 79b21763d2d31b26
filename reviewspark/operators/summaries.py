"""Summaries of large groups of reviews, level by level.

The summariser is exchangeable: any function from text to text. The default picks
the sentences whose words are the most frequent in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.numbers import adaptive_chunk
from reviewspark.functions.text import SPACE, preview, tokens, without
from reviewspark.operators.joins import join_groups
from reviewspark.operators.ranking import chunk_numbers
from reviewspark.runtime import cut, settle

Summariser = Callable[[str], str]

# What a report says when there is nothing to summarise.
NO_POSITIVE = "No positive reviews available."
NO_NEGATIVE = "No negative reviews available."
NOT_AVAILABLE = "Summary not available"


def leading_sentences(text: Column, most: int = 3, stop_words: Iterable[str] = ()) -> Column:
    """The `most` sentences with the highest mean word frequency, in text order.

    The JVM cuts the text into sentences and words; uses are counted and sentences chosen in
    Arrow batches. A missing text gives null.
    """
    sentences = F.transform(F.split(text, "[.!?\n]+"), lambda s: F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    words = F.transform(sentences, lambda s: without(tokens(s), stop_words))

    @F.arrow_udf("string")
    def chosen(parts: pa.Array, lists: pa.Array) -> pa.Array:
        places = leading_places(lists, most)
        # Places count within a text, the flat column of sentences over all texts.
        sizes = pc.list_value_length(parts).fill_null(0).to_numpy(zero_copy_only=False)
        kept = pc.list_value_length(places).to_numpy(zero_copy_only=False)
        at = np.repeat(np.cumsum(sizes) - sizes, kept) + places.flatten().to_numpy(zero_copy_only=False)
        told = pa.ListArray.from_arrays(places.offsets, parts.flatten().take(pa.array(at)))
        return pc.if_else(parts.is_valid(), pc.binary_join(told, ". "), pa.scalar(None, pa.string()))

    return chosen(sentences, words)


def leading_places(lists: pa.ListArray, most: int) -> pa.ListArray:
    """Places of the `most` leading sentences of each text, ascending; a text is a list of lists of words.

    A sentence without words is not chosen; equal means, to nine decimals, go to the earlier sentence.
    """
    n_sentences = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    inner = lists.flatten()
    n_words = pc.list_value_length(inner).fill_null(0).to_numpy(zero_copy_only=False)
    text_of = np.repeat(np.arange(len(lists)), n_sentences)
    sentence_of = np.repeat(np.arange(len(inner)), n_words)
    coded = inner.flatten().dictionary_encode()
    pairs = text_of[sentence_of] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    _, kind, uses = np.unique(pairs, return_inverse=True, return_counts=True)
    total = np.bincount(sentence_of, uses[kind], len(inner))
    told = np.flatnonzero(n_words)
    score = np.round(total[told] / n_words[told], 9)
    order = told[np.lexsort((told, -score, text_of[told]))]
    owner = text_of[order]
    # Place in the order of its own text: those before `most` are kept, then put in text order.
    kept = np.sort(order[np.arange(len(order)) - np.searchsorted(owner, owner) < most])
    starts = np.cumsum(n_sentences) - n_sentences
    places = kept - starts[text_of[kept]]
    ends = np.append(0, np.cumsum(np.bincount(text_of[kept], minlength=len(lists))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))


def summary_column(text: Column, make: Callable[[], Summariser] | None = None, attempts: int = 1) -> Column:
    """struct<summary, error> per text: `leading_sentences`, or a plugged-in model.

    `make` runs once per task, so a model loads once. A text that keeps failing gives an
    error instead of ending the job.
    """
    if make is None:
        told = leading_sentences(F.coalesce(text, F.lit("")))
        return F.struct(told.alias("summary"), F.lit(None).cast("string").alias("error"))

    # Texts go to the model one by one, and a batch of them is never held a second time.
    @F.arrow_udf("summary string, error string")
    def summarise(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for batch in batches:
            told = (_try(one, t.as_py(), attempts) for t in batch)
            yield pa.array(({"summary": s, "error": e} for s, e in told), _TOLD, size=len(batch))

    return summarise(text)


_TOLD = pa.struct([("summary", pa.string()), ("error", pa.string())])


def _try(one: Summariser, text: str | None, attempts: int) -> tuple[str | None, str | None]:
    error = None
    for _ in range(attempts):
        try:
            return one(text or ""), None
        except Exception as e:  # noqa: BLE001 - a plugged-in model may raise anything
            error = f"{type(e).__name__}: {e}"
    return None, error


def or_beginning(summary: Column, text: Column) -> Column:
    """The summary, or the beginning of the text where there is none."""
    return F.coalesce(summary, preview(text, 200))


def chunk_sizes(reviews: DataFrame, group: list[str], text: str, k: int) -> DataFrame:
    """Chunk size per group from the mean length of its reviews."""
    lengths = reviews.filter(F.col(text).isNotNull()).groupBy(*group).agg(F.avg(F.length(text)).alias("mean_length"))
    return lengths.withColumn("chunk_size", adaptive_chunk(F.col("mean_length"), k))


def hierarchical_summary(
    reviews: DataFrame, group: list[str], order: str, text: str, k: int,
    make: Callable[[], Summariser] | None = None, fan_in: int = 1000, attempts: int = 1,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One summary per group: chunks of k reviews first, then the summaries of at most `fan_in` chunks, and so on.

    A group of at most k reviews is summarised at once. No text grows with its group.
    `sizes` gives every group its own chunk size. Returns the group, summary, failed (texts
    of any level the model failed on) and error (the first message among them).
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 at least")
    rows = reviews.filter(F.col(text).isNotNull()).select(
        *group, order, F.col(text).alias("summary"), F.lit(0).cast("long").alias("failed"),
        F.lit(None).cast("string").alias("error"))
    if sizes is not None:
        rows = rows.join(sizes.select(*group, "chunk_size"), group)
    numbered = chunk_numbers(rows, group, order, k if sizes is None else F.col("chunk_size"))
    level = _summarised(_joined(numbered, group, "\n\n"), group, make, attempts)
    while True:
        level = cut(level)
        counts = level.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        if counts.filter(F.col("_n") > 1).limit(1).count() == 0:
            return level.select(*group, "summary", "failed", "error")
        sized = join_groups(level, counts, group)
        done = sized.filter(F.col("_n") == 1).drop("_n")
        parts = chunk_numbers(
            sized.filter(F.col("_n") > 1).drop("_n").withColumnRenamed("chunk_no", "_at"),
            group, "_at", fan_in,
        )
        level = _summarised(_joined(parts, group, " "), group, make, attempts)
        level = level.unionByName(done)


def _joined(numbered: DataFrame, group: list[str], separator: str) -> DataFrame:
    """The texts of each chunk as one, with the failures among them and the first message."""
    pairs = F.sort_array(F.collect_list(F.struct("row_no", F.col("summary").alias("t"))))
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("row_no", "error")))
    return (
        numbered.groupBy(*group, "chunk_no")
        .agg(pairs.alias("_pairs"), F.sum("failed").alias("_failed"), first["error"].alias("_error"))
        .select(*group, "chunk_no", F.array_join(F.col("_pairs.t"), separator).alias("_text"), "_failed", "_error")
    )


def _summarised(
    texts: DataFrame, group: list[str], make: Callable[[], Summariser] | None, attempts: int
) -> DataFrame:
    # Settled, as the summary and its error are both read from what is made once.
    made = settle(texts, "_s", summary_column(F.col("_text"), make, attempts)) if make is None else (
        texts.withColumn("_s", summary_column(F.col("_text"), make, attempts)))
    # Without a summary the beginning of the text stands in, so every group is reported.
    return made.select(
        *group, "chunk_no",
        or_beginning(F.col("_s.summary"), F.col("_text")).alias("summary"),
        (F.col("_failed") + F.col("_s.error").isNotNull().cast("long")).alias("failed"),
        F.coalesce("_error", "_s.error").alias("error"),
    )


def sentiment_summaries(
    reviews: DataFrame, order: str, text: str, k: int, make: Callable[[], Summariser] | None = None, **options
) -> DataFrame:
    """app_id, topic_id, positive_summary, negative_summary, failed, error; an empty side says so."""
    keys = ["app_id", "topic_id"]
    per_side = hierarchical_summary(
        reviews.filter(F.col("voted_up").isNotNull()), [*keys, "voted_up"], order, text, k, make, **options
    )
    side = lambda v: F.max(F.when(F.col("voted_up") == v, F.col("summary")))
    told = per_side.groupBy(*keys).agg(
        side(True).alias("_positive"),
        side(False).alias("_negative"),
        F.sum("failed").alias("_failed"),
        F.max(F.when(F.col("error").isNotNull(), F.struct("voted_up", "error")))["error"].alias("error"),
    )
    # A theme whose reviews all lack a vote has two empty sides.
    return reviews.select(*keys).distinct().join(told, keys, "left").select(
        *keys,
        F.coalesce("_positive", F.lit(NO_POSITIVE)).alias("positive_summary"),
        F.coalesce("_negative", F.lit(NO_NEGATIVE)).alias("negative_summary"),
        F.coalesce("_failed", F.lit(0)).alias("failed"),
        "error",
    )


def add_summaries(report: DataFrame, summaries: DataFrame) -> DataFrame:
    """Report + both summaries by key; rows that were not summarised say so."""
    joined = report.join(summaries, ["app_id", "topic_id"], "left").fillna(0, subset=["failed"])
    return joined.fillna(NOT_AVAILABLE, subset=["positive_summary", "negative_summary"])

