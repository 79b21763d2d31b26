"""Theme centroids and the assignment of each review to the nearest theme of its product.

Seed words become inverted lists, (product, term) to the themes that use the term. While they
pass the size check they go to the executors once and no review is shuffled; beyond it each
review meets the packed themes of its product in a join that keeps one row per review.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.arrays import as_lists, count_terms, counted_terms, in_slices, with_value
from reviewspark.functions.text import tokens, without
from reviewspark.functions.vectors import cosine, dot, norm, squared_distance, term_norm
from reviewspark.operators.aggregate import mean_vector
from reviewspark.runtime import BROADCAST_BYTES, cut, discard, fits

# Scores that agree to this many decimals count as equal, so that the winner does not
# depend on the order in which products were added up.
SCORE_DECIMALS = 9


def term_vectors(df: DataFrame, text: str, stop_words: Iterable[str] = (), out: str = "terms") -> DataFrame:
    """The default embedding: word counts of a text as array<struct<term, tf>>."""
    words = without(tokens(F.coalesce(F.col(text), F.lit(""))), stop_words)
    return df.withColumn(out, count_terms(words))


def hashed_vectors(
    df: DataFrame, text: str, n_features: int = 1 << 18, stop_words: Iterable[str] = ()
) -> DataFrame:
    """Word counts in `n_features` hash buckets, scaled to length 1: `buckets` of (term, weight)."""
    words = without(tokens(F.coalesce(F.col(text), F.lit(""))), stop_words)

    @F.arrow_udf("array<struct<term: bigint, weight: double>>")
    def hashed(batch: pa.Array) -> pa.Array:
        done = []
        for lists in in_slices(batch):
            # A distinct word of the slice is hashed once; words of a text that meet in a bucket add up.
            row, term, uses, terms = counted_terms(lists)
            bucket = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % n_features for w in terms.to_pylist()], np.int64)
            pairs, at = np.unique(row * n_features + bucket[term], return_inverse=True)
            tf = np.bincount(at, uses, len(pairs))
            row, place = np.divmod(pairs, n_features)
            length = np.sqrt(np.bincount(row, tf * tf, len(lists)))
            done.append(as_lists(row, len(lists), term=pa.array(place), weight=pa.array(tf / length[row])))
        return pa.concat_arrays(done) if done else pa.nulls(0, pa.list_(pa.struct([("term", pa.int64()), ("weight", pa.float64())])))

    return df.withColumn("buckets", hashed(words))


def unit_weights(df: DataFrame, terms: str, out: str) -> DataFrame:
    """Scale a sparse vector to length 1."""
    entry = lambda n: lambda x: F.struct(
        x["term"].alias("term"), (x["tf"] / n).alias("weight")
    )
    scaled = with_value(
        F.col(terms), lambda t: with_value(term_norm(t), lambda n: F.transform(t, entry(n)))
    )
    return df.withColumn(out, scaled)


def seed_weights(themes: DataFrame, stop_words: Iterable[str] = ()) -> DataFrame:
    """app_id, topic_id, term, weight; one row with a null term for a theme without words.

    Laid out by product once, which serves every grouping up to the packed rows.
    """
    usable = F.filter("seeds", lambda s: F.coalesce(s, F.lit("")) != "")
    seeds = (
        themes.select("app_id", "topic_id", usable.alias("seeds"))
        .repartition("app_id")
        .select("app_id", "topic_id", F.size("seeds").alias("n"), F.explode_outer("seeds").alias("seed"))
    )
    vectors = unit_weights(term_vectors(seeds, "seed", stop_words), "terms", "vec")
    return (
        vectors.select("app_id", "topic_id", "n", F.inline_outer("vec"))
        .groupBy("app_id", "topic_id", "term")
        .agg((F.sum("weight") / F.max("n")).alias("weight"))
    )


def seed_centroids(themes: DataFrame, stop_words: Iterable[str] = ()) -> DataFrame:
    """Mean of the unit word vectors of a theme's seeds: app_id, topic_id, term, weight."""
    return seed_weights(themes, stop_words).filter(F.col("term").isNotNull())


def _pack(per_theme: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per product with its themes in topic order (a hand-written, short list)."""
    return per_theme.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("topic_id", *fields))).alias("themes")
    )


def pack_seeds(themes: DataFrame, stop_words: Iterable[str] = ()) -> DataFrame:
    """Product rows for `assign_terms`; themes without usable seeds get an empty vector."""
    entry = F.when(F.col("term").isNotNull(), F.struct("term", "weight"))
    per_theme = (
        seed_weights(themes, stop_words)
        .groupBy("app_id", "topic_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("weights"))
        .withColumn("norm", term_norm(F.col("weights"), "weight"))
    )
    return _pack(per_theme, ["app_id"], ["norm", "weights"])


def pack_vectors(centroids: DataFrame, keys: list[str], vector: str = "centroid") -> DataFrame:
    """Product rows for `assign_vectors` out of one dense centroid per topic."""
    per_theme = centroids.select(
        *keys, "topic_id", norm(F.col(vector)).alias("norm"), F.col(vector).alias("centroid")
    )
    return _pack(per_theme, keys, ["norm", "centroid"])


def _best(df: DataFrame, scores: Column) -> DataFrame:
    """Adds topic_id and similarity from a list of scores; no themes means topic 0."""
    scored = df.withColumn("_scores", scores).withColumn("_top", F.array_max("_scores"))
    at = F.array_position("_scores", F.col("_top")).cast("int") - 1
    return (
        scored.withColumn("topic_id", F.coalesce(F.get(F.col("themes.topic_id"), at), F.lit(0)))
        .withColumn("similarity", F.coalesce("_top", F.lit(0.0)))
        .drop("_scores", "_top", "themes")
    )


@dataclass
class Entries:
    """The terms of a column of texts, one entry for each row and term."""

    row: np.ndarray
    term: np.ndarray  # place in `terms`
    weight: np.ndarray
    terms: pa.Array
    length: np.ndarray  # of each row's vector

    @classmethod
    def of_words(cls, words: pa.ListArray) -> Entries:
        """Uses of every word, out of lists of words."""
        coded = words.flatten().dictionary_encode()
        width = max(1, len(coded.dictionary))
        pairs, uses = np.unique(_owners(words) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, term = np.divmod(pairs, width)
        return cls._measured(row, term, uses.astype(np.float64), coded.dictionary, len(words))

    @classmethod
    def of_weights(cls, weights: pa.ListArray) -> Entries:
        """Out of lists of (term, weight)."""
        term, weight = weights.flatten().flatten()
        coded = term.dictionary_encode()
        return cls._measured(_owners(weights), coded.indices.to_numpy(zero_copy_only=False),
                             weight.cast(pa.float64()).to_numpy(zero_copy_only=False), coded.dictionary, len(weights))

    @classmethod
    def _measured(cls, row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: pa.Array, n: int) -> Entries:
        return cls(row, term, weight, terms, np.sqrt(np.bincount(row, weight**2, n)))


def _owners(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))


@dataclass
class TermIndex:
    """Sparse vectors of many products' topics as inverted lists: (product, term) to the topics that use it, with weights.

    `score` works on whole Arrow batches; a text costs its terms and the list entries they meet.
    """

    apps: pa.Array  # product ids, in the order the numbers below count them
    first: np.ndarray  # where a product's topics start in `topics`; one entry more than products
    topics: np.ndarray
    norms: np.ndarray
    terms: pa.Array
    keys: np.ndarray  # product * number of terms + term, in order
    starts: np.ndarray  # where a key's list starts; one more than keys
    places: np.ndarray  # topic's place among those of its product
    weights: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> TermIndex:
        """Out of (app_id, topic_id, term, weight); a null term stands for a topic without words."""
        rows = rows.filter(pc.is_valid(rows["app_id"])).combine_chunks()
        app = rows["app_id"].combine_chunks().dictionary_encode()
        product = app.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        topic = rows["topic_id"].to_numpy().astype(np.int64)
        order = np.lexsort((topic, product))
        starts_topic = np.ones(len(order), bool)
        starts_topic[1:] = (np.diff(product[order]) != 0) | (np.diff(topic[order]) != 0)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(starts_topic) - 1
        heads = order[starts_topic]
        first = np.searchsorted(product[heads], np.arange(len(app.dictionary) + 1))
        weight = rows["weight"].combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        norms = np.sqrt(np.bincount(number, weight**2, len(heads)))
        term = rows["term"].combine_chunks().dictionary_encode()
        listed = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        key = product[listed] * len(term.dictionary) + term.indices.fill_null(0).to_numpy(zero_copy_only=False)[listed]
        place = (number - first[product])[listed]
        order = np.lexsort((place, key))
        keys, starts = np.unique(key[order], return_index=True)
        return cls(app.dictionary, first, topic[heads].astype(np.int32), norms, term.dictionary, keys,
                   np.append(starts, len(order)), place[order], weight[listed][order])

    def score(self, apps: pa.Array, x: Entries, metric: str = "cosine") -> tuple[np.ndarray, np.ndarray]:
        """Best topic and its score for each row, the lower topic on a tie; rows without topics get topic 0 and 0.

        The score is the cosine, or the negative squared distance less the text's own length.
        """
        n = len(apps)
        topic, best = np.zeros(n, np.int32), np.zeros(n)
        if not len(self.topics):
            return topic, best
        product = pc.index_in(apps.cast(self.apps.type), self.apps).fill_null(-1).to_numpy(zero_copy_only=False)
        term = pc.index_in(x.terms.cast(self.terms.type), self.terms).fill_null(-1).to_numpy(zero_copy_only=False)[x.term]
        # Keys that the product has, and what each of them adds to which topic.
        on = (term >= 0) & (product[x.row] >= 0)
        row, weight, wanted = x.row[on], x.weight[on], product[x.row[on]] * np.int64(len(self.terms)) + term[on]
        at = np.searchsorted(self.keys, wanted)
        on = np.flatnonzero(np.append(self.keys, -1)[at] == wanted)
        row, weight, at = row[on], weight[on], at[on]
        many = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        # One slot for each row and topic of its product.
        n_topics = np.where(product >= 0, self.first[product + 1] - self.first[product], 0)
        ends = np.cumsum(n_topics)
        slot_row = np.repeat(np.arange(n), n_topics)
        which = np.repeat(self.first[product] - ends + n_topics, n_topics) + np.arange(len(slot_row))
        slot = np.repeat((ends - n_topics)[row], many) + self.places[entry]
        dots = np.bincount(slot, np.repeat(weight, many) * self.weights[entry], len(slot_row))
        if metric == "cosine":
            lengths = x.length[slot_row] * self.norms[which]
            scores = np.divide(dots, lengths, out=np.zeros(len(slot_row)), where=lengths > 0)
        else:
            scores = 2 * dots - self.norms[which] ** 2
        scores = np.round(scores, SCORE_DECIMALS)
        filled = np.flatnonzero(n_topics)
        if len(filled):
            best[filled] = np.maximum.reduceat(scores, (ends - n_topics)[filled])
            found = np.flatnonzero(scores == best[slot_row])
            rows, where = np.unique(slot_row[found], return_index=True)
            topic[rows] = self.topics[which[found[where]]]
        return topic, best


_ASSIGNED = "topic_id int, similarity double"


def _as_struct(topic: np.ndarray, similarity: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(topic, pa.int32()), pa.array(similarity, pa.float64())], ["topic_id", "similarity"])


def _scored(apps: pa.Array, batch: pa.ListArray, score: Callable) -> pa.StructArray:
    """Topics of a batch, a slice of its terms at a time."""
    topic, similarity, at = np.zeros(len(batch), np.int32), np.zeros(len(batch)), 0
    for lists in in_slices(batch):
        end = at + len(lists)
        topic[at:end], similarity[at:end] = score(apps.slice(at, len(lists)), lists)
        at = end
    return _as_struct(topic, similarity)


def _with_best(df: DataFrame, best: Column, columns: list[str]) -> DataFrame:
    return df.withColumn("_best", best).select(*columns, "_best.topic_id", "_best.similarity")


def assign_by_index(texts: DataFrame, index: TermIndex, terms: Column, metric: str = "cosine") -> DataFrame:
    """Nearest topic by an index that goes to the executors once; no text is shuffled.

    `terms` are words or (term, weight) entries.
    """
    shared = texts.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf(_ASSIGNED)
    def nearest(apps: pa.Array, batch: pa.Array) -> pa.Array:
        entries = Entries.of_weights if pa.types.is_struct(batch.type.value_type) else Entries.of_words
        return _scored(apps, batch, lambda apps, lists: shared.value.score(apps, entries(lists), metric))

    return _with_best(texts, nearest(F.col("app_id"), terms), texts.columns)


def sums_by_index(texts: DataFrame, index: TermIndex, weights: str, metric: str = "euclidean") -> DataFrame:
    """(app_id, topic_id, term, total): weights of the texts nearest to a topic, added up by term in each Arrow batch.

    A null term counts the texts. Rows of several batches are still to be added; no entry of a text leaves the task.
    """
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, done = 0, []
            for lists in in_slices(batch.column(1)):
                apps, at = batch.column(0).slice(at, len(lists)), at + len(lists)
                done.append(_term_sums(apps, lists, shared.value, metric))
            if done:
                added = pa.concat_tables(done).group_by(["app_id", "topic_id", "term"], use_threads=False)
                yield from added.aggregate([("total", "sum")]).rename_columns(["app_id", "topic_id", "term", "total"]).to_batches()

    kind = texts.schema["app_id"].dataType.simpleString()
    return texts.select("app_id", weights).mapInArrow(summed, f"app_id {kind}, topic_id int, term string, total double")


def _term_sums(apps: pa.Array, lists: pa.ListArray, index: TermIndex, metric: str) -> pa.Table:
    x = Entries.of_weights(lists)
    topic, _ = index.score(apps, x, metric)
    product = apps.dictionary_encode()
    codes = product.indices.fill_null(len(product.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    _, heads, cell = np.unique(codes * (np.int64(topic.max()) + 1) + topic, return_index=True, return_inverse=True)
    width = max(1, len(x.terms))
    pairs, where = np.unique(cell[x.row] * width + x.term, return_inverse=True)
    of, term = np.divmod(pairs, width)
    at = np.append(heads[of], heads)
    return pa.table({
        "app_id": apps.take(pa.array(at)), "topic_id": pa.array(topic[at], pa.int32()),
        "term": pa.concat_arrays([x.terms.cast(pa.string()).take(pa.array(term)), pa.nulls(len(heads), pa.string())]),
        "total": pa.array(np.append(np.bincount(where, x.weight, len(pairs)), np.bincount(cell, minlength=len(heads))), pa.float64())})


def assign_terms(reviews: DataFrame, packed: DataFrame, words: Column) -> DataFrame:
    """The same where the themes outgrow a broadcast: each review meets the packed row of its product.

    The index of a batch is made of the products that occur in it.
    """

    @F.arrow_udf(_ASSIGNED)
    def nearest(apps: pa.Array, themes: pa.Array, batch: pa.Array) -> pa.Array:
        seen = pc.unique(apps.filter(themes.is_valid()))
        index = TermIndex.of(_unpacked(seen, themes.take(pc.index_in(seen, apps))))
        return _scored(apps, batch, lambda apps, lists: index.score(apps, Entries.of_words(lists)))

    joined = reviews.join(packed, "app_id", "left")
    return _with_best(joined, nearest(F.col("app_id"), F.col("themes"), words), reviews.columns)


def _unpacked(apps: pa.Array, themes: pa.ListArray) -> pa.Table:
    """Packed rows as (app_id, topic_id, term, weight); a theme without words has a null term."""
    theme = themes.flatten()
    lists = theme.field("weights")
    owner, empty = _owners(lists), np.flatnonzero(pc.list_value_length(lists).to_numpy(zero_copy_only=False) == 0)
    at = pa.array(np.append(owner, empty))
    term, weight = lists.flatten().flatten()
    return pa.table({
        "app_id": apps.take(pa.array(_owners(themes))).take(at), "topic_id": theme.field("topic_id").take(at),
        "term": pa.concat_arrays([term, pa.nulls(len(empty), term.type)]),
        "weight": pa.concat_arrays([weight, pa.nulls(len(empty), weight.type)])})


def assign_vectors(
    df: DataFrame, packed: DataFrame, vector: str, keys: list[str], metric: str = "cosine"
) -> DataFrame:
    """Nearest theme of the row's keys by cosine or Euclidean distance of dense vectors.

    `similarity` is the cosine, or the negative squared distance.
    """
    joined = df.join(packed, keys, "left")

    def cosines(v: Column) -> Column:
        near = lambda n: lambda t: F.round(
            cosine(dot(v, t["centroid"]), n, t["norm"]), SCORE_DECIMALS
        )
        return with_value(norm(v), lambda n: F.transform("themes", near(n)))

    def closeness(v: Column) -> Column:
        return F.transform(
            "themes", lambda t: F.round(-squared_distance(v, t["centroid"]), SCORE_DECIMALS)
        )

    measure = cosines if metric == "cosine" else closeness
    return _best(joined, with_value(F.col(vector).cast("array<double>"), measure))


def nearest_vectors(
    df: DataFrame, centroids: DataFrame, vector: str, keys: list[str], metric: str = "cosine",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """`assign_vectors` out of unpacked centroids (keys, topic_id, centroid).

    Centroids within `limit` bytes go to the executors once, as matrices, and whole Arrow
    batches are compared with them; measured on vectors of 384 numbers this is six times as
    fast as expressions. Larger ones with keys are joined, each row to those of its keys;
    without keys they go to the executors one part after the other, each within the limit,
    and a row keeps the best so far. All ways give the same: vectors that are missing, hold a missing
    number or have another length than a centroid do not meet it, and a row that meets
    none gets topic 0 and similarity 0.
    """
    size = F.size("centroid") * 8 + 64
    total = centroids.agg(F.sum(size)).first()[0] or 0
    if total > limit and keys:
        return assign_vectors(df, pack_vectors(centroids, keys), vector, keys, metric)
    columns, meet = df.columns, F.struct(*keys) if keys else F.struct(F.lit(0).alias("_"))
    if total <= limit:
        nearest, _ = _meet(df.sparkSession, _matrices(centroids, keys), metric)
        near = df.withColumn("_near", nearest(meet, F.col(vector)))
        return near.select(*columns, F.coalesce("_near.topic_id", F.lit(0)).alias("topic_id"),
                           F.coalesce("_near.similarity", F.lit(0.0)).alias("similarity"))
    # Twice as many parts as fit, since hashing does not fill them evenly. One part at a time is held by the
    # driver and the executors; what is best so far is written before the next one comes.
    parts = 2 * -(-total // limit)
    part = F.pmod(F.xxhash64("topic_id"), F.lit(parts))
    near = df.withColumn("_best", F.lit(None).cast("struct<far: double, topic_id: int>"))
    for i in range(parts):
        nearest, held = _meet(df.sparkSession, _matrices(centroids.filter(part == i), keys), metric)
        found = F.when(F.col("_near.topic_id").isNotNull(),
                       F.struct((-F.col("_near.similarity")).alias("far"), F.col("_near.topic_id").alias("topic_id")))
        further = cut(near.withColumn("_near", nearest(meet, F.col(vector))).select(*columns, F.least("_best", found).alias("_best")))
        held.destroy()
        if i:
            discard(near)
        near = further
    return near.select(*columns, F.coalesce("_best.topic_id", F.lit(0)).alias("topic_id"),
                       F.coalesce(-F.col("_best.far"), F.lit(0.0)).alias("similarity"))


def _meet(spark, matrices: dict, metric: str):
    """A function of (keys, vector) that gives the best topic in `matrices`, or nulls; and the broadcast it holds."""
    tables = spark.sparkContext.broadcast(matrices)

    @F.pandas_udf("topic_id int, similarity double")
    def nearest(keys: pd.DataFrame, vectors: pd.Series) -> pd.DataFrame:
        topic, score = np.full(len(vectors), None, object), np.full(len(vectors), np.nan)
        rows_of: dict = {}
        for i, (key, v) in enumerate(zip(keys.itertuples(index=False, name=None), vectors)):
            if v is not None and (key, len(v)) in tables.value and not any(x is None for x in v):
                rows_of.setdefault((key, len(v)), []).append(i)
        for key, rows in rows_of.items():
            topics, matrix = tables.value[key]
            points = np.stack(vectors.iloc[rows].to_numpy()).astype("float64")
            scores = np.round(_scores(points, matrix, metric), SCORE_DECIMALS)
            best = scores.argmax(axis=1)
            topic[rows], score[rows] = topics[best], scores[np.arange(len(rows)), best]
        return pd.DataFrame({"topic_id": pd.array(topic, "Int32"), "similarity": score})

    return nearest, tables


def _matrices(centroids: DataFrame, keys: list[str]) -> dict:
    """(keys, length) -> topic ids and one matrix row per topic, in topic order. Only for what fits."""
    tables: dict = {}
    for row in sorted(centroids.collect(), key=lambda r: r["topic_id"]):
        v = row["centroid"]
        if v is not None and all(x is not None for x in v):
            key = tuple(row[k] for k in keys) if keys else (0,)
            topics, vectors = tables.setdefault((key, len(v)), ([], []))
            topics.append(row["topic_id"])
            vectors.append(v)
    return {k: (np.array(t), np.array(v, "float64")) for k, (t, v) in tables.items()}


def _scores(points: np.ndarray, matrix: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        lengths = np.outer(np.linalg.norm(points, axis=1), np.linalg.norm(matrix, axis=1))
        return np.divide(points @ matrix.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
    return np.stack([-((points - c) ** 2).sum(axis=1) for c in matrix], axis=1)


def assign_by_text(
    reviews: DataFrame, themes: DataFrame, text: str = "review", stop_words: Iterable[str] = (), limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Reviews + topic_id and similarity by the words they share with the seeds of their product's themes.

    Texts are cut into words by the JVM; words are counted and looked up in Arrow batches.
    A missing text has no words; a product without themes, or a null one, gives topic 0.
    """
    # A seed word costs its text, a weight and the row layout around both.
    size = F.length(F.array_join("seeds", " ")) * 16 + 256
    words = without(tokens(F.coalesce(F.col(text), F.lit(""))), stop_words)
    if not fits(themes, size, limit):
        return assign_terms(reviews, pack_seeds(themes, stop_words), words)
    # Bounded by the measure above.
    return assign_by_index(reviews, TermIndex.of(seed_weights(themes, stop_words).toArrow()), words)


def vector_centroids(seeds: DataFrame, vector: str = "embedding") -> DataFrame:
    """Dense centroids from seed vectors: app_id, topic_id, centroid."""
    return mean_vector(seeds, ["app_id", "topic_id"], vector)
