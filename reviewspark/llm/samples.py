"""Bounded samples of labelled rows, to fit classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewspark.llm.common import stored, text_key

MOST_LABELS = 1000


def labelled_sample(
    docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, per_label: int, pieces: int, length: int
) -> tuple[list[tuple], dict]:
    """([(label, [piece, ...])], {label: texts}): at most `per_label` different texts of each label.

    `labelled` has (_id, _key, _label): the rows to learn from, without their texts; `_key`
    is the text's key. A text's place in the order is the hash of its key, so copies count
    once and the choice repeats exactly. Only the chosen rows' texts are fetched, by a
    broadcast of at most labels * per_label keys; no text is shuffled. Of each text `pieces`
    parts of `length` characters come along, spread evenly from its start to its end, so the
    driver gets at most labels * per_label * pieces * length characters. Texts per label are
    counted over all rows, approximately.
    """
    x = labelled.select("_label", "_id", "_key").filter("_label is not null and _id is not null and _key is not null")
    x = stored(x, "labelled")
    counted = x.groupBy("_label").agg(F.approx_count_distinct("_key", 0.02).alias("n")).limit(MOST_LABELS + 1).collect()
    if len(counted) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counted:
        return [], {}
    counts = {r["_label"]: r["n"] for r in counted}
    # Twice the wanted share first, so that the order below never sees a whole label.
    share: Column = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col("_label") == F.lit(value), F.lit(min(1.0, (2 * per_label + 50) / max(n, 1)))).otherwise(share)
    place = F.pmod(F.xxhash64("_key"), F.lit(1 << 40)) / float(1 << 40)
    x = x.filter(place < share).groupBy("_label", "_key").agg(F.min("_id").alias("_id"))
    order = Window.partitionBy("_label").orderBy(place, "_key")
    chosen = x.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_label).drop("_n")
    chosen = stored(chosen, "chosen")

    step = F.greatest(F.length("_text") - length, F.lit(0)) / max(1, pieces - 1)
    parts = F.array(*[F.substring("_text", (step * i).cast("int") + 1, F.lit(length)) for i in range(pieces)])
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).alias("_text"))
    texts = texts.join(F.broadcast(chosen), ["_id", "_key"]).select("_label", "_key", F.array_distinct(parts).alias("_parts"))
    got = {(r["_label"], r["_key"]): r["_parts"] for r in texts.dropDuplicates(["_label", "_key"]).collect()}
    return [(label, got[label, key]) for label, key in sorted(got, key=lambda k: (k[1], k[0]))], counts
