import json

import pytest
from pyspark.sql import functions as F

from reviewspark.catalogue.binding import table
from reviewspark.schema import REPORT_INPUT, REVIEWS
from reviewspark.sources import raw_json, reviews, sinks
from reviewspark.sources.themes import parse_themes
from reviewspark.streaming import incremental


def product(app_id, reviews_=None, **data):
    body = {"name": f"P{app_id}", "steam_appid": app_id, **data}
    if reviews_ is not None:
        body["review_stats"] = {"reviews": reviews_}
    return {str(app_id): {"success": True, "data": body}}


def write_raw(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_raw_documents(spark, tmp_path):
    review = {"language": "english", "review": "ok", "voted_up": True, "weighted_vote_score": "0.5", "author": {"steamid": "7"}}
    write_raw(tmp_path, "1.json", product(1, [review, {"review": None, "weighted_vote_score": 0.25}, {"weighted_vote_score": None}],
                                          price_overview={"final_formatted": "1,00"}, genres=[{"description": "Puzzle"}], required_age="18"))
    write_raw(tmp_path, "2.json", product(2, []))
    write_raw(tmp_path, "3.json", product(3))
    write_raw(tmp_path, "4.json", "{broken")
    write_raw(tmp_path, "5.json", {"5": {"success": False}})
    raw = raw_json.read_raw(spark, str(tmp_path))
    flat = raw_json.flatten(raw_json.products(raw))
    assert flat.schema.names == REVIEWS.names
    rows = flat.collect()
    assert len(rows) == 3 and {r.steam_appid for r in rows} == {1}
    assert sorted(r.weighted_vote_score for r in rows if r.weighted_vote_score is not None) == [0.25, 0.5]
    first = next(r for r in rows if r.review == "ok")
    assert (first.price_overview, first.genres, first.categories, first.required_age, first.author_steamid) == ("1,00", ["Puzzle"], [], 18, "7")
    totals = {r.app_id: r.total_num_reviews for r in raw_json.review_totals(raw_json.products(raw)).collect()}
    assert totals == {1: 3, 2: 0, 3: 0}
    assert sorted(r.reason for r in raw_json.rejects(raw).collect()) == ["no successful product", "not a document"]
    summary = {(r.app_id, r.is_total): r.review_count for r in raw_json.conversion_summary(flat).collect()}
    assert summary == {(1, 0): 3, (None, 1): 3}


def test_resumed_ingest(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    write_raw(source, "1.json", product(1, [{"review": "a"}]))
    incremental.ingest_documents(spark, str(source), target, state).awaitTermination()
    write_raw(source, "2.json", product(2, [{"review": "b"}, {"review": "c"}]))
    for _ in range(2):
        incremental.ingest_documents(spark, str(source), target, state).awaitTermination()
    got = spark.read.schema(REVIEWS).parquet(target).select("steam_appid", "review").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "b"), (2, "c")]


def write_reviews(spark, path, rows):
    df = spark.createDataFrame(rows, "steam_appid bigint, review string, review_language string, voted_up boolean")
    df.coalesce(1).write.parquet(path)


def test_files_and_identity(spark, tmp_path):
    write_reviews(spark, f"{tmp_path}/a", [(1, "x", "english", True), (1, None, "english", True), (9, "foreign", "english", False)])
    write_reviews(spark, f"{tmp_path}/b", [(5, "y", "german", True), (4, "z", "english", False)])
    write_reviews(spark, f"{tmp_path}/c", [(None, "lost", "english", True)])
    rows = reviews.with_file(spark.read.schema(REVIEWS).parquet(f"{tmp_path}/*").select(*REPORT_INPUT, "name", "_metadata"))
    identity = reviews.file_identity(rows)
    assert sorted((r.app_id, r.name) for r in identity.collect()) == [(1, None), (4, None)]
    themes = parse_themes(spark.createDataFrame([('{"1": {"t": ["x"]}}',)], "value string"))
    assert [r.app_id for r in reviews.accepted_files(identity, themes).collect()] == [1]
    skipped = reviews.skipped_files(rows.select("file").distinct(), identity, themes).collect()
    assert sorted((r.app_id or 0, r.reason) for r in skipped) == [(0, "no product id"), (4, "product has no themes")]
    own = reviews.usable_reviews(reviews.own_rows(rows, identity))
    assert sorted(r.review for r in own.collect()) == ["x", "z"]
    kept = reviews.usable_reviews(reviews.own_rows(rows, identity), keep_null_text=True)
    assert sorted(r.review for r in kept.collect()) == ["", "x", "z"]


def test_scan_is_pruned_and_filtered(spark, tmp_path):
    write_reviews(spark, f"{tmp_path}/a", [(1, "x", "english", True)])
    df = reviews.usable_reviews(reviews.read_reviews(spark, f"{tmp_path}/a"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(review_language,english)" in plan
    assert "detailed_description" not in plan


def test_report_plan_has_one_scan_of_the_text(spark, tiny):
    from reviewspark.catalogue import QUERIES

    plan = QUERIES["theme_report"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_query_pairs_everything(spark, tiny):
    from reviewspark.catalogue import QUERIES

    for name in ("theme_assignment", "playtime_stats", "chunk_documents", "class_tfidf_terms", "text_join_fanout", "product_identity"):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_csv_keeps_odd_text(spark, tmp_path):
    odd = ['say "hi"', "a,b\nnext line", "back\\slash", "", None, "#note", "'single'"]
    df = spark.createDataFrame([(i, t, ["x", t or "-"]) for i, t in enumerate(odd)], "id int, t string, l array<string>")
    for quote_all in (False, True):
        path = f"{tmp_path}/{quote_all}"
        sinks.write_csv(df, path, quote_all=quote_all)
        back = sinks.read_csv(spark, path, "id int, t string, l string", quote_all).orderBy("id").collect()
        assert [r.id for r in back] == list(range(len(odd)))
        assert [r.t or "" for r in back] == [t or "" for t in odd]
        assert [json.loads(r.l) for r in back] == [["x", t or "-"] for t in odd]


def test_delivered_names(spark):
    row = spark.createDataFrame([(1, "t", 3, 2, 1)], "app_id int, theme string, review_count bigint, positive bigint, negative bigint")
    assert sinks.deliver(row).columns == ["steam_appid", "Theme", "#Reviews", "Positive", "Negative"]


def test_first_source_wins(spark):
    one = spark.createDataFrame([(1, "one")], "app_id int, x string")
    two = spark.createDataFrame([(1, "two"), (2, "two"), (2, "more")], "app_id int, x string")
    got = reviews.first_source([one, two], "app_id").select("app_id", "x").collect()
    assert sorted(map(tuple, got)) == [(1, "one"), (2, "more"), (2, "two")]


def test_streams_over_several_batches(spark, tmp_path, tiny):
    """Two files in two batches count like one batch; centroids move batch by batch."""
    vectors = table(spark, tiny, "embeddings")
    half = F.col("vec_id") % 2 == 0
    vectors.filter(half).coalesce(1).write.parquet(f"{tmp_path}/v/a")
    vectors.filter(~half).coalesce(1).write.parquet(f"{tmp_path}/v/b")
    stream = spark.readStream.schema(vectors.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/v/*")
    label = lambda b: b.select(F.col("label").alias("topic_id"), (F.col("vec_id") % 3 == 0).alias("voted_up"))
    incremental.count_themes(stream, label, ["topic_id"], f"{tmp_path}/counts", f"{tmp_path}/c1").awaitTermination()
    got = {(r.topic_id, r.review_count, r.positive) for r in incremental.running_counts(spark, f"{tmp_path}/counts", ["topic_id"]).collect()}
    want = {(r.topic_id, r.n, r.p) for r in label(vectors).groupBy("topic_id").agg(F.count("*").alias("n"), F.count_if("voted_up").alias("p")).collect()}
    assert got == want
    assert spark.read.parquet(f"{tmp_path}/counts").select("batch").distinct().count() == 2

    seeds = spark.createDataFrame([(0, [0.0] * 64)], "topic_id int, centroid array<double>")
    incremental.move_centroids(stream, seeds, "embedding", f"{tmp_path}/state", f"{tmp_path}/c2").awaitTermination()
    moved = incremental.latest_centroids(spark, f"{tmp_path}/state").first().centroid
    sums = vectors.select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double")).alias("s")).orderBy("d").collect()
    n = vectors.count()
    assert all(abs(m - r.s / (n + 1)) < 1e-9 for m, r in zip(moved, sums))


def test_labels_follow_the_moved_centroids_and_targets_are_not_shared(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in (0, 1, 9, 10)], "id bigint, v array<double>")
    rows.coalesce(1).write.parquet(f"{tmp_path}/v")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/v")
    seeds = spark.createDataFrame([(0, [0.0, 0.0]), (1, [4.0, 0.0])], "topic_id int, centroid array<double>")
    run = lambda c: incremental.move_centroids(
        stream, seeds, "v", f"{tmp_path}/state", f"{tmp_path}/{c}", labels=f"{tmp_path}/labels", key="id")
    run("c1").awaitTermination()
    got = {r.id: r.topic_id for r in spark.read.parquet(f"{tmp_path}/labels").collect()}
    assert got == {0: 0, 1: 0, 9: 1, 10: 1}
    run("c1").awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        run("c2")
