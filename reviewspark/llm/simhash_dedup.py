"""Near-duplicate documents by 64-bit fingerprints, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from reviewspark.llm.common import fresh, same, stored, text_key, word_blocks
from reviewspark.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
# Fingerprints of one tile; two tiles are compared in slices of rows.
TILE = 2048
SLICE = 256
# A fingerprint is four blocks of 16 bits with 0 to 16 bits set each: at most 17^4 cells.
BLOCKS = 4
_BASE = 17
_LANES = np.uint64(0x0101010101010101)


def _hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    if text is None:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass").lower()
    parts = []
    n_words = 0
    for words in word_blocks(data, width - 1):
        n_words = len(words)
        runs = map(b" ".join, zip(*(words[i:] for i in range(width))))
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64))
    if parts and not any(map(len, parts)) and n_words:
        parts = [np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def fingerprints_of(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """One fingerprint per text: a bit is set if more than half of the shingle hashes have it.

    The hashes are added up in eight byte lanes at a time, at most 255 in a sum, so no bit
    is spread out into a number of its own.
    """
    each = [_hashes(t, width) for t in texts]
    n = np.array([len(h) for h in each], np.int64)
    out = np.zeros(len(each), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    h = np.concatenate([each[i] for i in full])
    size = n[full]
    first = np.cumsum(size) - size
    pieces = -(-size // 255)
    of_piece = np.cumsum(pieces) - pieces
    start = np.repeat(first - 255 * of_piece, pieces) + 255 * np.arange(pieces.sum())
    bits = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, start)
        lanes = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(lanes, of_piece, axis=0, dtype=np.int64)
        for byte in range(8):
            on = 2 * count[:, byte] > size
            bits |= on.astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = bits
    return out


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A few hundred texts at a time keep the hashes of a batch of long texts small.
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                bits = fingerprints_of(part.column("_text").to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_key"), pa.array(bits)], ["_id", "_key", "_fp"]
                )

    return run


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """(_id, _key, _fp) per row of `docs`; `_key` tells texts of one id apart."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).alias("_text")
    )
    return rows.mapInArrow(_fingerprint_batches(width), "_id long, _key long, _fp long")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Label of every node: the smallest one it is connected to by the links (i, j)."""
    label = np.arange(n)
    while True:
        old = label
        label = label.copy()
        low = np.minimum(old[i], old[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, old[i], low)
        np.minimum.at(label, old[j], low)
        label = label[label]
        if (label == old).all():
            return label


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of two tiles, as a spanning star of each connected part.

    All differences are counted, but of a dense part only one link per fingerprint leaves
    the tile pair, which keeps the connection and not the square of the part.
    """
    rows, cols = [], []
    for at in range(0, len(a), SLICE):
        near = np.bitwise_count(a[at : at + SLICE, None] ^ b[None, :]) <= radius
        r, c = np.nonzero(near)
        rows.append(r + at)
        cols.append(c)
    i, j = np.concatenate(rows), np.concatenate(cols) + len(a)
    both = np.concatenate([a, b])
    other = both[i] != both[j]
    i, j = i[other], j[other]
    if not len(i):
        return both[:0], both[:0]
    label = _forest(i, j, len(both))
    node = np.flatnonzero(label != np.arange(len(both)))
    return both[node], both[label[node]]


def _tile_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(x) for x in ("_left", "_right"))
            found = []
            for k in range(batch.num_rows):
                a, b = (x[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right))
                u, v = tile_links(a, b, radius)
                if len(u):
                    found.append((u, v))
            if found:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return run


def _counts(fp: Column) -> list[Column]:
    """Bits set in each 16-bit block."""
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)).cast("int") for i in range(BLOCKS)]


def _cell(p: list[Column]) -> Column:
    out = F.lit(0)
    for x in p:
        out = out * _BASE + x
    return out


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of block counts within the radius, one of each pair of opposite ones."""
    steps: list[tuple[int, ...]] = [()]
    for _ in range(BLOCKS):
        steps = [s + (d,) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in steps if s >= (0,) * BLOCKS]


def fingerprint_links(distinct: DataFrame, fp: str = "_fp", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect what lies within `radius` bits, over distinct fingerprints.

    A cell holds the fingerprints with the same number of bits set in each of the four
    blocks. Flipping one bit changes one of these numbers by one, so two fingerprints
    within the radius lie in cells whose numbers differ by at most the radius in all;
    every other pair of tiles is skipped. A cell of any size is dealt out into tiles of
    about `tile` fingerprints, and a pair of tiles is one row. The table of cell sizes has
    at most 17^4 rows, so it may be broadcast.
    """
    x = distinct.select(F.col(fp).alias("_fp"))
    x = stored(x.select("_fp", _cell(_counts(F.col("_fp"))).alias("_cell")), "fingerprints")
    sizes = x.groupBy("_cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    sizes = stored(sizes, "cells")
    dealt = x.join(F.broadcast(sizes), "_cell").select(
        "_cell", F.pmod(F.xxhash64("_fp"), F.col("_tiles")).cast("int").alias("_tile"), "_fp"
    )
    tiles = stored(dealt.groupBy("_cell", "_tile").agg(F.collect_list("_fp").alias("_fps")), "tiles")

    of = [(F.col("_cell") / _BASE ** (BLOCKS - 1 - i)).cast("int") % _BASE for i in range(BLOCKS)]
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in _steps(radius)])).alias("_step")
    at = [of[i] + F.col("_step")[i] for i in range(BLOCKS)]
    inside = F.lit(True)
    for q in at:
        inside = inside & q.between(0, 16)
    pairs = (
        sizes.select("_cell", F.col("_tiles").alias("_n"), step)
        .filter(inside)
        .select("_cell", "_n", _cell(at).alias("_other"))
        .join(F.broadcast(sizes.select(F.col("_cell").alias("_other"), F.col("_tiles").alias("_m"))), "_other")
        .select("_cell", "_other", "_m", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_tile"))
        .select("_cell", "_tile", "_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_with"))
        .filter((F.col("_cell") != F.col("_other")) | (F.col("_tile") <= F.col("_with")))
    )
    left = tiles.select("_cell", "_tile", F.col("_fps").alias("_left"))
    right = tiles.select(F.col("_cell").alias("_other"), F.col("_tile").alias("_with"), F.col("_fps").alias("_right"))
    joined = pairs.join(left, ["_cell", "_tile"]).join(right, ["_other", "_with"]).select("_left", "_right")
    return joined.mapInArrow(_tile_batches(radius), "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS,
    tile: int = TILE, with_key: bool = False,
) -> DataFrame:
    """Per document its fingerprint and the smallest id reachable over links of near fingerprints.

    Rows: (doc_id, fingerprint as 16 hex digits, component_id), one per row of `docs`.
    Words are runs of anything but ASCII white space, A-Z lower-cased; a text with fewer
    words than a shingle is one shingle, and a null, empty or blank text has fingerprint
    zero, which links like any other. Rows with a null id keep their row; a null id is
    never a component's id unless all its rows have none. Repeated rows stay repeated. An
    empty table gives no rows. Other columns are not read. `with_key` adds the text key and a
    component number that is never null.
    """
    rows = stored(with_fingerprints(docs, id_col, text_col, width), "documents-fp")
    distinct = stored(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct-fp")
    parts = stored(components(fingerprint_links(distinct, "_fp", radius, tile)), "parts")
    members = distinct.join(parts, distinct["_fp"] == parts["node"], "left").select(
        "_fp", "_least", F.coalesce("component", "_fp").alias("_part")
    )
    least = members.groupBy("_part").agg(F.min("_least").alias("component_id"))
    labels = members.join(least, "_part").select("_fp", "_part", "component_id")
    keep = ["_key", "_part"] if with_key else []
    return rows.join(labels, "_fp").select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", *keep
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: the smallest id (a null id only where there is
    no other), of rows that share it the one with the smallest text key; columns unchanged.

    Rows equal in id and text but not in other columns are one document: the row with the
    smallest hash of its columns (but for maps) stays, whatever the order of rows. Null and
    empty texts are a component of their own. An empty table stays empty.
    """
    found = stored(simhash_components(docs, id_col, text_col, with_key=True), "groups")
    row = F.struct("doc_id", "_key")
    kept = found.groupBy("_part").agg(
        F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), row)), F.min(row)).alias("_w"))
    rid, rkey = fresh(docs, "_rid", "_rkey")
    kept = stored(kept.select(F.col("_w.doc_id").alias(rid), F.col("_w._key").alias(rkey)), "kept")
    out = docs.join(
        kept, same(F.col(id_col).cast("long"), F.col(rid)) & same(text_key(text_col), F.col(rkey)), "left_semi")
    repeated = found.groupBy("doc_id", "_key").count().filter("count > 1").limit(1).count() > 0
    if not repeated:
        return out
    id_, key, hash_, least = fresh(docs, "_id", "_key", "_h", "_least")
    hashed = F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)])
    out = out.withColumns({id_: F.col(id_col), key: text_key(text_col), hash_: hashed})
    first = out.groupBy(id_, key).agg(F.min(hash_).alias(least)).withColumnsRenamed({id_: rid, key: rkey})
    chosen = same(F.col(id_), F.col(rid)) & same(F.col(key), F.col(rkey)) & (F.col(hash_) == F.col(least))
    return out.join(first, chosen, "left_semi").dropDuplicates([id_, key]).select(*docs.columns)
