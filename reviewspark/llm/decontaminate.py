"""Benchmark items in documents: fingerprints of item-sized windows, a multi-index, exact similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.arrays import with_value
from reviewspark.llm.common import fresh, same, stored, text_key
from reviewspark.runtime import broadcast_if_small, settle

SHINGLE = 5
SIMILARITY = 0.8
# Two texts of similarity 0.8 differ in about 10 of 64 bits, and in more than RADIUS of them
# about once in two thousand times.
RADIUS = 19
BITS = 64


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, width: int = SHINGLE) -> Column:
    """A hash for every `width` words that follow each other; `w` must be a column or a lambda variable."""
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))
    return F.slice(hashes, 1, F.greatest(F.size(w) - width + 1, F.lit(0)))


def fingerprint(hashes: Column) -> Column:
    """64 bits, each set if more than half of the hashes (repeats included) have it set."""
    def bit(b: Column) -> Column:
        on = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.call_function("shiftrightunsigned", h, b).bitwiseAND(1).cast("int"))
        return F.when(on * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _blocks(radius: int) -> list[int]:
    """Masks of radius + 1 blocks: of two fingerprints within the radius at least one block is equal."""
    edges = [b * BITS // (radius + 1) for b in range(radius + 2)]
    masks = [sum(1 << i for i in range(a, z)) for a, z in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _indexed(df: DataFrame, radius: int) -> DataFrame:
    """One row for each block of the fingerprint `_fp`."""
    parts = F.array(*[F.col("_fp").bitwiseAND(F.lit(m)) for m in _blocks(radius)])
    return df.select("*", F.posexplode(parts).alias("_block", "_part"))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger weights; a shingle weighs as often as it occurs."""
    def count(x: Column, h: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == h))

    both = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, _key, item_id, start_word, n_words, distance, similarity) for every document that holds an item.

    A window has as many words as the item. Windows are fingerprinted where a document
    holds at least `similarity` of the item's shingles anywhere, at each place that lines
    one of them up with the item: a window that holds fewer cannot be similar enough. The
    fingerprints meet those of all items of that many words in an index of radius + 1
    blocks, which finds every one within `radius` bits; what it finds is measured exactly,
    by the weighted shingles of window and item. Of several windows the most similar one is
    reported, of equal ones the first.

    Items of fewer than five words, null or empty ones have no shingle and are found
    nowhere; equal items are each found; null and empty texts hold nothing. `_key` tells
    rows that share an id apart; rows equal in id and text give one result. Rows with null
    ids take part. Other columns are not read.
    """
    items = settle(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("_t")), "_w", words(F.col("_t")))
    items = items.select("item_id", F.size("_w").alias("_n"), shingles(F.col("_w")).alias("_item"))
    items = items.filter(F.size("_item") > 0).select("*", fingerprint(F.col("_item")).alias("_fp"))
    items = stored(items.select("*", F.xxhash64("item_id", "_item").alias("_no")).distinct(), "items")
    bytes_ = F.size("_item") * 8 + 64

    rows = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).alias("_text"))
    placed = items.select("_no", F.size("_item").alias("_m"), F.posexplode("_item").alias("_q", "_h"))
    placed = broadcast_if_small(placed, F.lit(40))
    anchors = (
        settle(rows, "_w", words(F.col("_text")))
        .select("_id", "_key", F.posexplode(shingles(F.col("_w"))).alias("_p", "_h"))
        .join(placed, "_h")
        .groupBy("_id", "_key", "_no", "_m")
        .agg(F.collect_set("_p").alias("_places"), F.collect_set(F.col("_p") - F.col("_q")).alias("_starts"))
        .filter(F.size("_places") >= F.col("_m") * similarity)
        .select("_id", "_key", "_no", "_starts")
    )
    anchors = stored(anchors, "anchors")
    wanted = anchors.select(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey"), "_no", "_starts")
    wanted = wanted.join(broadcast_if_small(items.select("_no", "_n"), F.lit(32)), "_no")
    wanted = broadcast_if_small(wanted, F.size("_starts") * 4 + 64)

    def window(s: Column) -> Column:
        first = F.greatest(s, F.lit(0))
        return F.struct(first.alias("at"), F.slice(F.col("_w"), first + 1, F.greatest(s + F.col("_n") - first, F.lit(0))).alias("w"))

    near = rows.join(wanted, same(F.col("_id"), F.col("_rid")) & same(F.col("_key"), F.col("_rkey")))
    near = settle(near, "_w", words(F.col("_text")))
    near = near.select("_id", "_key", "_n", F.explode(F.transform("_starts", window)).alias("_x"))
    near = near.select("_id", "_key", "_n", F.col("_x.at").alias("_at"), F.col("_x.w").alias("_w")).distinct()
    near = near.select("_id", "_key", "_n", "_at", shingles(F.col("_w")).alias("_window")).filter(F.size("_window") > 0)
    near = stored(near.select("*", fingerprint(F.col("_window")).alias("_fp")), "windows")

    index = broadcast_if_small(
        _indexed(items, radius).select("item_id", "_n", "_item", F.col("_fp").alias("_ifp"), "_block", "_part"),
        bytes_ * (radius + 1), measured=items)
    differ = F.col("_fp").bitwiseXOR(F.col("_ifp"))
    first_equal = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(_blocks(radius))])
    met = _indexed(near, radius).join(index, ["_n", "_block", "_part"]).filter(F.col("_block") == first_equal)
    met = met.filter(F.bit_count(differ) <= radius)
    measured = met.select(
        "_id", "_key", "item_id", "_n", "_at", F.bit_count(differ).cast("int").alias("_d"),
        weighted_similarity(F.col("_window"), F.col("_item")).alias("_s")).filter(F.col("_s") >= similarity)
    best = measured.groupBy("_id", "_key", "item_id").agg(
        F.min(F.struct((-F.col("_s")).alias("s"), F.col("_at").alias("at"), F.col("_n").alias("n"), F.col("_d").alias("d"))).alias("_b"))
    return best.select(
        F.col("_id").alias("doc_id"), "_key", "item_id", F.col("_b.at").cast("long").alias("start_word"),
        F.col("_b.n").cast("long").alias("n_words"), F.col("_b.d").alias("distance"), (-F.col("_b.s")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without those that hold a benchmark item; columns and other rows unchanged.

    Null and empty texts hold none and stay, also with a null id. Rows equal in id and text go
    or stay together; of rows that share an id only, those whose text holds an item go. An
    empty `docs` or `benchmark` leaves `docs` as it is.
    """
    rid, rkey = fresh(docs, "_rid", "_rkey")
    found = benchmark_hits(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(rid), F.col("_key").alias(rkey))
    found = broadcast_if_small(stored(found.distinct(), "contaminated"), F.lit(32))
    return docs.join(found, same(F.col(id_col), F.col(rid)) & same(text_key(text_col), F.col(rkey)), "left_anti")
