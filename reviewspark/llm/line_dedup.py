"""Lines repeated across documents, found by windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.functions.arrays import with_value
from reviewspark.llm.common import fresh, same, stored, text_key

WINDOW = 3


def two_hashes(*values: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits. A leading constant changes the seed, so neither follows from the other."""
    return F.xxhash64(*values).alias("x"), F.xxhash64(F.lit(7), *values).alias("y")


def _line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct(*two_hashes(x)))


def _windows(text: Column, width: int) -> Column:
    """128 bits for each run of `width` lines; none for shorter texts."""

    def run(lines: Column) -> Column:
        n = F.size(lines)
        shifted = [F.slice(lines, i + 1, n - width + 1) for i in range(width)]
        zipped = F.arrays_zip(*shifted)

        def both(z: Column) -> Column:
            parts = [z[str(i)] for i in range(width)]
            return F.struct(two_hashes(*[p["x"] for p in parts])[0], two_hashes(*[p["y"] for p in parts])[1])

        return F.when(n >= width, F.transform(zipped, both))

    return with_value(_line_hashes(text), run)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(_id, _key, _starts): per document the windows that occurred before, by first line.

    The first occurrence of a window is the one with the smallest (id, text key, line); a
    null id comes first. Windows are counted with map-side minima and only those met twice
    are joined back, where adaptive execution splits a window that very many documents
    share. What is gathered per document is bounded by its own lines.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), text_key(text_col).alias("_key"), F.posexplode(_windows(F.col(text_col), width)).alias("_at", "_w"))
    rows = stored(rows.select("_id", "_key", "_at", F.col("_w.x").alias("_x"), F.col("_w.y").alias("_y")), "windows")
    place = F.struct("_id", "_key", "_at")
    first = rows.groupBy("_x", "_y").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    first = first.filter(F.col("_first") != F.col("_last"))
    later = rows.join(first, ["_x", "_y"]).filter(~same(place, F.col("_first")))
    return later.groupBy("_id", "_key").agg(F.collect_set("_at").alias("_starts"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, lines_col: str = "n_lines",
    removed_col: str = "n_removed",
) -> DataFrame:
    """`docs` with later occurrences of repeated line windows taken out of the text.

    Adds n_lines and n_removed (or what `lines_col` and `removed_col` say) and replaces the text column. Every line that lies in a
    window which occurred before (in an earlier document or further up) goes; windows that
    overlap remove their lines once. Lines are parted by line feeds, and an empty line is
    a line. Texts of fewer lines than a window, empty ones and nulls stay as they are (null
    has no lines, empty has one). Rows that are equal in id and text are one document: they
    stay repeated and lose the same lines. Other columns pass through; of the two added
    names, one that `docs` already has is replaced.
    """
    rid, rkey, starts = fresh(docs, "_rid", "_rkey", "_starts")
    found = repeated_lines(docs, id_col, text_col, width).select(
        F.col("_id").alias(rid), F.col("_key").alias(rkey), F.col("_starts").alias(starts))
    joined = docs.join(found, same(F.col(id_col), F.col(rid)) & same(text_key(text_col), F.col(rkey)), "left")

    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + width - 1))))
    lines = F.split(text_col, "\n", -1)

    def cut(x: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(left, lambda i: F.get(x["lines"], i)), "\n")

    text = F.when(F.col(starts).isNull(), F.col(text_col)).otherwise(
        with_value(F.struct(covered.alias("gone"), lines.alias("lines")), cut))
    kept = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in (lines_col, removed_col)]
    return joined.select(
        *kept,
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(lines_col),
        F.when(F.col(starts).isNull(), 0).otherwise(F.size(covered)).cast("long").alias(removed_col),
    )
