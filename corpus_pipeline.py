"""A corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import fresh, stored, table
from reviewspark.llm.decontaminate import drop_contaminated
from reviewspark.llm.language_cnn import fit_languages, keep_known
from reviewspark.llm.line_dedup import dedup_lines
from reviewspark.llm.pieces import PieceModel, encode_texts
from reviewspark.llm.simhash_dedup import keep_one_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows; it learns from a bounded sample of tagged ones.

    Texts without a letter go, and those whose best language has a chance under 0.3, which
    is the operator's default and not fitted to any corpus.
    """
    return keep_known(docs, fit_languages(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines seen before; a document that loses all its lines goes.

    A text that loses lines gets its new length in `n_chars`, where there is such a column.
    All other columns, whatever their names, stay as they are, and so do null and empty texts.
    """
    lines, removed = fresh(docs, "n_lines", "n_removed")
    done = dedup_lines(docs, lines_col=lines, removed_col=removed)
    done = done.filter((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col(removed) > 0, length).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints: the one with the smallest id.

    Null and empty texts share the fingerprint zero and are a group.
    """
    return keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as piece ids, which decode to its text; all columns but the text stay.

    A column that is called like one of the new ones gets an underscore at its end. A null
    text has null ids, an empty one none.
    """
    new = ["ids", "n_tokens", "n_bytes", "round_trip"]
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    taken = docs.select("doc_id", *others)
    clash = {c: fresh(taken, c)[0] for c in others if c.lower() in new}
    named = docs.withColumnsRenamed(clash)
    return encode_texts(named, PieceModel.load(), keep=[clash.get(c, c) for c in others])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# Convolutions, XXH64 fingerprints and Viterbi have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, cut by Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
