"""Spelling variants: words one edit apart, found by pivotal bigrams against gram prefixes, and grouped under frequent forms."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import drop_stored, stored

# The letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
# Bigrams are told apart by 16 bits, so their counts are a bounded table for any alphabet.
GRAMS = 1 << 16
# Grams of a prefix: one edit touches at most two, so of three rare ones two lie apart.
PREFIX = 3

_BASE = np.uint64(0x9E3779B97F4A7C15)


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[Column, Column], Column] | None = None,
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A to Z lower-cased, and how often each occurs.

    `edit` (id as text, run) may change a run before it is counted; it may shorten but not
    lengthen it. Words have at least `least_length` code points and `least_count` occurrences.
    Null and empty texts have no words, a null id counts as an empty one, repeated rows count
    each. Counts are added up inside every task before they are shuffled, so a frequent word
    costs one row a task.
    """
    lowered = F.translate(F.col(text_col), UPPER, LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.col("run") if edit is None else edit(F.col("id"), F.col("run"))
    counted = words.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, code points as a matrix) of the words of each length."""
    length = np.array([len(w) for w in words])
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        flat = "".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass")
        yield at, np.frombuffer(flat, np.uint32).reshape(len(at), n)


def grams(codes: np.ndarray) -> np.ndarray:
    """Number of the bigram at every place."""
    return (codes[:, :-1] * np.uint32(256) + codes[:, 1:]) & np.uint32(GRAMS - 1)


def prefixes(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last, member): the rank of each word's third rarest bigram, and the places of bigrams no more frequent.

    All places of a bigram are in or out together, however often a word repeats it.
    """
    last = np.partition(rank, PREFIX - 1, axis=1)[:, PREFIX - 1]
    return last, rank <= last[:, None]


def pivots(cost: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two disjoint bigrams of each prefix with the smallest sum of counts.

    Dynamic programme over places: the cheapest pivot that ends before a place, then the
    cheapest pair whose second pivot stands there. Ties go to the first found from the left.
    """
    dear = np.int64(1) << np.int64(61)
    cost = np.where(member, cost, dear)
    n, width = cost.shape
    rows = np.arange(n)
    one, one_at = np.full(n, dear), np.zeros(n, np.int64)
    best, first, second = np.full(n, 2 * dear), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in range(2, width):
        less = cost[:, at - 2] < one
        one, one_at = np.where(less, cost[:, at - 2], one), np.where(less, at - 2, one_at)
        both = one + cost[rows, at]
        less = both < best
        best, first, second = np.where(less, both, best), np.where(less, one_at, first), np.where(less, at, second)
    return first, second


def _sides(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what stands before and of what stands from every place on, as (words, length + 1)."""
    n, width = codes.shape
    before, after = np.zeros((n, width + 1), np.uint64), np.zeros((n, width + 1), np.uint64)
    letters = codes.astype(np.uint64) + np.uint64(1)
    for i in range(width):
        before[:, i + 1] = (before[:, i] ^ letters[:, i]) * _BASE
        before[:, i + 1] ^= before[:, i + 1] >> np.uint64(29)
        j = width - 1 - i
        after[:, j] = (after[:, j + 1] ^ letters[:, j]) * _BASE
        after[:, j] ^= after[:, j] >> np.uint64(29)
    return before, after


def _key(side: np.ndarray, place: np.ndarray, length: int, kind: int) -> np.ndarray:
    x = side ^ ((place.astype(np.uint64) << np.uint64(32)) + np.uint64(length * 2 + kind)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * _BASE
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(GRAMS, np.int64)
    for b in batches:
        for _, codes in _by_length(b.column("word").to_pylist()):
            total += np.bincount(grams(codes).ravel(), minlength=GRAMS)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["gram", "n"])


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each bigram stands in the words: at most `GRAMS` sums reach the driver."""
    out = np.zeros(GRAMS, np.int64)
    counted = words.select("word").mapInArrow(_count_grams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        out[r["gram"]] = r["n"]
    return out


def _keys(counts, probe: bool):
    """Rows (_key, word, n, last) of the pivots, for each place an edit may move them to, or of the prefix grams."""

    def of_length(codes: np.ndarray, cost: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        length = codes.shape[1]
        g = grams(codes)
        last, member = prefixes(rank[g])
        before, after = _sides(codes)
        rows = np.arange(len(codes))
        if probe:
            one, two = pivots(cost[g], member)
            out = []
            for other in (length - 1, length, length + 1):
                out.append((rows, _key(before[rows, one + 2], one, other, 0), last))
                out.append((rows, _key(after[rows, two], two + (other - length), other, 1), last))
            return out
        r, at = np.nonzero(member)
        return [(r, _key(before[r, at + 2], at, length, 0), last[r]), (r, _key(after[r, at], at, length, 1), last[r])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = counts.value
        rank = np.empty(GRAMS, np.int64)
        rank[np.lexsort((np.arange(GRAMS), cost))] = np.arange(GRAMS)
        for b in batches:
            for at, codes in _by_length(b.column("word").to_pylist()):
                for r, key, last in of_length(codes, cost, rank):
                    place = pa.array(at[r])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, pa.int64()), b.column("word").take(place), b.column("n").take(place), pa.array(last, pa.int32())],
                        ["_key", "word", "n", "last"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways round: pairs that differ by one inserted, deleted or replaced code point.

    Bigrams are ordered by how often they stand in the words. A word's prefix is its three
    rarest bigrams, its pivots two disjoint ones of them, chosen by their counts. One edit
    leaves a pivot alone, so of two near words the one whose prefix ends with the rarer
    bigram has a pivot that stands in the other's prefix; and it stands where the edit lets
    it: before the edit at the same place, after it moved by the difference in length. If
    the edit comes after the first pivot, all up to that pivot is equal in both words, else
    all from the second pivot on; the keys hold those parts, the place and the other's
    length, so that one equality join gives few candidates, and every one is verified.

    `words` has distinct words (word, n) of at least four code points. No words, no pairs.
    """
    counts = words.sparkSession.sparkContext.broadcast(gram_counts(words))
    kind = "_key long, word string, n long, last int"
    rows = words.select("word", "n")
    left = rows.mapInArrow(_keys(counts, probe=True), kind)
    right = rows.mapInArrow(_keys(counts, probe=False), kind).select(
        "_key", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("last").alias("_near_last"))
    met = left.join(
        right,
        (left["_key"] == right["_key"]) & (F.col("last") <= F.col("_near_last"))
        & (F.levenshtein("word", "near", 1) == 1))
    there = met.select("word", "n", "near", "near_n")
    back = met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return there.unionByName(back).distinct()


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root): every word followed to its last form, by doubling the way known so far.

    A form occurs at least `ratio` times as often, so a way has at most log(most) steps.
    """
    way = stored(forms.select("word", F.col("form").alias("root")), "spelling-way")
    steps = math.ceil(math.log(max(most, 2), ratio)) + 1 if ratio > 1 else most
    for _ in range(max(1, steps.bit_length())):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = stored(way.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-way")
        drop_stored(way)
        way = further
    return way


def spelling_variants(words: DataFrame, ratio: int = RATIO, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of a table of distinct words and their counts.

    `n_near` counts the words one edit away (`near_words`). `form` is the one of them with
    the largest count, ties to the smallest word in code-point order, if it occurs at least
    `ratio` times as often as the word, else null; `root` is the last form on the way from
    the word, or the word itself; `form_n` is the form's count. `ratio` is above 1, so that
    no way returns.

    Rows with a null word or count and words of under four code points take no part. Words
    given twice are one word whose counts add up. Other columns are not read; an empty
    table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio has to be above 1")
    known = words.select(F.col(word_col).alias("word"), F.col(n_col).cast("long").alias("n"))
    known = known.filter("word is not null and n is not null and char_length(word) >= 4")
    known = stored(known.groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    near = near_words(known).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    fits = F.col("near_n") >= ratio * F.col("n")
    placed = known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    placed = stored(placed, "spelling-forms")
    most = known.agg(F.max("n")).first()[0] or 1
    roots = _roots(placed.filter("form is not null"), most, ratio)
    return placed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
