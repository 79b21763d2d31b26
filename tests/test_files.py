"""Files that say what they hold, and folders with damaged files."""

import gzip
import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reviewspark.sources.damaged import listed_files, lost_rows, read_undamaged
from reviewspark.sources.labelled import STAGING, read_labels, write_labelled
from reviewspark.sources.sinks import read_csv

KIND = "app int, id long, text string, tags array<string>"


def frame(spark, n=400):
    rows = [([1, 1, 1, 2, None, 7][i % 6], i, f'say "{i}"\n# not a comment\\, really', ["a,b", None] if i % 2 else None) for i in range(n)]
    return spark.createDataFrame(rows, KIND).repartition(5)


def names(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("."))


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_pairs_of_every_file(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    df = frame(spark)
    write_labelled(df, path, "app", kind, rows=60)
    assert all(n.startswith("app=") and n.endswith(kind) for n in names(path))
    told = [(r.file, r.labels) for r in read_labels(spark, path, kind).collect()]
    assert len(told) == len(names(path)) and all(int(x["total_reviews"]) <= 60 for _, x in told)
    totals = {}
    for file, x in told:
        assert set(x) == {"app", "total_reviews", "processed_at"} and f"app={x['app']}-" in file
        totals[x["app"]] = totals.get(x["app"], 0) + int(x["total_reviews"])
    want = {str(r.app): r.n for r in df.groupBy("app").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert totals == want
    if kind == "parquet":
        back = spark.read.schema(KIND).parquet(path)
        found = pq.read_metadata(told[0][0].removeprefix("file:")).metadata
        assert found[b"total_reviews"].decode() == told[0][1]["total_reviews"]
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    else:
        back = read_csv(spark, path, "app int, id long, text string, tags string")
        flat = df.withColumn("tags", F.to_json("tags"))
        assert {r.id: (r.app, r.text) for r in back.collect()} == {r.id: (r.app, r.text) for r in flat.collect()}


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    write_labelled(frame(spark, 60), path, "app")
    first = names(path)
    write_labelled(frame(spark, 60), path, "app", mode="append")
    assert set(first) < set(names(path)) and len(names(path)) == 2 * len(first)
    write_labelled(frame(spark, 6), path, "app")
    assert spark.read.parquet(path).count() == 6 and not set(first) & set(names(path))
    write_labelled(frame(spark, 6).filter("false"), path, "app")
    assert names(path) == []
    with pytest.raises(ValueError):
        write_labelled(frame(spark, 6), path, "app", kind="txt")


def test_odd_keys_in_names(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a/b", 1), ("../c", 2), ("", 3), (None, 4), ("ü %", 5)], "k string, id long")
    write_labelled(df, path, "k")
    assert {r.labels["k"] for r in read_labels(spark, path).collect()} == {"a/b", "../c", "", "None", "ü %"}
    assert len(names(path)) == 5 and spark.read.parquet(path).count() == 5


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_labelled(frame(spark, 12), path, "app")
    before = names(path)
    broken = frame(spark).withColumn("text", F.when(F.col("id") == 333, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        write_labelled(broken, path, "app")
    assert names(path) == before and not os.path.exists(f"{path}/{STAGING}")


def test_damaged_parquet(spark, tmp_path):
    path = str(tmp_path / "in")
    frame(spark, 500).repartition(4).write.parquet(path)
    good = [f"{path}/{f}" for f in names(path) if f.endswith(".parquet")]
    rows = {f: pq.read_metadata(f).num_rows for f in good}
    os.makedirs(f"{path}/more")
    shutil.copy(good[0], f"{path}/more/cut off.parquet")
    with open(f"{path}/more/cut off.parquet", "r+b") as f:
        f.truncate(os.path.getsize(good[0]) // 2)
    open(f"{path}/more/nothing.parquet", "wb").close()
    with open(f"{path}/more/text.parquet", "w") as f:
        f.write("no parquet at all")
    frame(spark, 6).filter("false").coalesce(1).write.parquet(f"{path}/more/norows")
    read, rejects = read_undamaged(spark, path, KIND)
    assert read.count() == sum(rows.values()) == 500
    told = {os.path.basename(r.file): (r.bytes, r.reason) for r in rejects.collect()}
    assert set(told) == {"cut off.parquet", "nothing.parquet", "text.parquet"}
    assert told["nothing.parquet"] == (0, "empty file") and "Invalid" in told["text.parquet"][1]
    assert lost_rows(spark, path, read, KIND).count() == 0
    assert listed_files(spark, path, "*.parquet").count() == len(good) + 2 + len([f for f in names(f"{path}/more/norows") if f.endswith("parquet")])


def test_a_broken_page_shows_as_lost_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(i, "x" * 50 + str(i)) for i in range(2000)], "id long, text string").coalesce(1).write.parquet(path)
    file = next(f"{path}/{f}" for f in names(path) if f.endswith(".parquet"))
    meta = pq.read_metadata(file).row_group(0).column(1)
    with open(file, "r+b") as f:
        f.seek(meta.data_page_offset)
        f.write(b"\xff" * 40)
    for crc in os.listdir(path):
        if crc.endswith(".crc"):
            os.remove(f"{path}/{crc}")
    read, rejects = read_undamaged(spark, path, "id long, text string")
    assert rejects.count() == 0
    lost = lost_rows(spark, path, read, "id long, text string").collect()
    assert [(os.path.basename(r.file), r.expected) for r in lost] == [(os.path.basename(file), 2000)] and lost[0].found < 2000


def test_damaged_text(spark, tmp_path):
    path = str(tmp_path / "in")
    os.makedirs(path)
    with gzip.open(f"{path}/whole.csv.gz", "wt") as f:
        f.write("1,a\n2,b\n")
    with open(f"{path}/plain.csv", "w") as f:
        f.write("3,c\n")
    with open(f"{path}/broken.csv.gz", "wb") as f:
        f.write(b"\x1f\x8b\x08\x00garbage that is no stream")
    read, rejects = read_undamaged(spark, path, "id int, t string", kind="csv")
    assert {(r.id, r.t) for r in read.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert [os.path.basename(r.file) for r in rejects.collect()] == ["broken.csv.gz"]
