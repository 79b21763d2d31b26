"""Words that stand for a theme or topic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.arrays import count_terms, with_value
from reviewspark.functions.text import tokens, without
from reviewspark.functions.vectors import cosine, dot, norm
from reviewspark.operators.aggregate import mean_vector
from reviewspark.operators.ranking import top_rows
from reviewspark.runtime import broadcast_if_small, cut


# What one task counts: characters of texts, and terms of documents.
TASK_CHARS = 2_000_000
TASK_TERMS = 1_000_000


def terms_of(text: Column, stop_words: Iterable[str] = (), bigrams: bool = False) -> Column:
    words = without(tokens(text), stop_words)
    if not bigrams:
        return words
    rest = lambda w, at: F.slice(w, at, F.greatest(F.size(w) - 1, F.lit(0)))
    pairs = lambda w: F.zip_with(rest(w, 1), rest(w, 2), lambda a, b: F.concat_ws(" ", a, b))
    return with_value(words, lambda w: F.concat(w, pairs(w)))


def explode_terms(docs: DataFrame, keep: list[str], words: Column) -> DataFrame:
    """One row per word. The outer form spares Spark a filter that would split every text twice."""
    return docs.select(*keep, F.explode_outer(words).alias("term")).filter(F.col("term").isNotNull())


def top_terms(weights: DataFrame, group: list[str], k: int = 10) -> DataFrame:
    """The k heaviest terms per group, ties by the term itself."""
    return top_rows(weights, group, [F.desc("weight"), F.asc("term")], k)


def tfidf_weights(
    docs: DataFrame, group: str, key: str, text: str, vocabulary: int | None = None,
    stop_words: Iterable[str] = (), bigrams: bool = True, decimals: int = 9,
) -> DataFrame:
    """Mean TF-IDF weight per group and term, over all terms or the `vocabulary` most frequent ones.

    idf = ln((1 + n) / (1 + df)) + 1; each document is scaled to length 1. Words are counted
    inside the row, so a text leaves its task as its distinct terms.
    """
    # Documents that a join left in few tasks are spread before their words are counted.
    measured = docs.agg(F.sum(F.length(text))).first()[0] or 0
    spread = docs.select(group, key, text).repartition(max(1, -(-measured // TASK_CHARS)))
    # Read four times below; as large as the documents' distinct terms.
    counted = count_terms(terms_of(F.col(text), stop_words, bigrams))
    tf = cut(spread.select(group, key, F.inline_outer(counted)).filter(F.col("term").isNotNull()))
    # Most pairs of words are rare, so adding up in the map tasks would hold nearly all of them.
    by_term = tf.select("term", "tf").repartition(max(1, -(-tf.count() // TASK_TERMS)), "term")
    kept = by_term.groupBy("term").agg(F.sum("tf").alias("uses"), F.count(F.lit(1)).alias("df"))
    if vocabulary is not None:
        kept = kept.orderBy(F.desc("uses"), "term").limit(vocabulary)
    sizes = docs.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    n_docs = sizes.agg(F.sum("n")).scalar()
    idf = kept.select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(broadcast_if_small(cut(idf), F.length("term") * 2 + 32), "term").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return (
        weighted.join(lengths, key)
        .groupBy(group, "term")
        .agg(F.sum(F.col("w") / F.col("length")).alias("total"))
        .join(sizes, group)
        .select(group, "term", F.round(F.col("total") / F.col("n"), decimals).alias("weight"))
    )


def class_tfidf_weights(
    docs: DataFrame, group: str, text: str, stop_words: Iterable[str] = (), decimals: int = 9
) -> DataFrame:
    """Class TF-IDF: share of the group's words x ln(1 + words per group / uses of the term)."""
    # Read four times below; the texts themselves only here.
    uses = cut(
        explode_terms(docs, [group], terms_of(F.col(text), stop_words))
        .groupBy(group, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    words = uses.groupBy(group).agg(F.sum("tf").alias("words"))
    everywhere = uses.groupBy("term").agg(F.sum("tf").alias("uses"))
    mean_words = words.agg(F.avg("words")).scalar()
    return (
        uses.join(everywhere, "term")
        .join(words, group)
        .select(
            group,
            "term",
            F.round(
                F.col("tf") / F.col("words") * F.log(1 + mean_words / F.col("uses")), decimals
            ).alias("weight"),
        )
    )


def rerank_terms(
    candidates: DataFrame, docs: DataFrame, group: str, key: str, text: str, vector: str,
    stop_words: Iterable[str] = (), k: int = 10,
) -> DataFrame:
    """Candidate terms of a topic by how close they lie to its centre.

    A term lies at the mean vector of the documents that use it.
    """
    known = candidates.select("term").distinct()
    words = F.array_distinct(terms_of(F.col(text), stop_words))
    uses = explode_terms(docs, [key, vector], words).join(known, "term", "left_semi")
    term_at = mean_vector(uses, ["term"], vector, out="at")
    centre = mean_vector(docs, [group], vector, out="centre")
    near = F.round(cosine(dot(F.col("at"), F.col("centre")), norm(F.col("at")), norm(F.col("centre"))), 9)
    scored = (
        candidates.select(group, "term")
        .join(term_at, "term")
        .join(centre, group)
        .select(group, "term", near.alias("weight"))
    )
    return top_terms(scored, [group], k)


def keyword_text(top: DataFrame, group: list[str], out: str = "top_keywords") -> DataFrame:
    """The top terms of each group as one comma-separated text (k terms at most)."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return top.groupBy(*group).agg(ranked.alias("_t")).select(
        *group, F.array_join(F.col("_t.term"), ", ").alias(out)
    )
