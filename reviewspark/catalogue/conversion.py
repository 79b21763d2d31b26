"""Nested documents to flat reviews, inputs, sinks and what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewspark.catalogue.binding import APP, REVIEWS_SQL, THEMES_SQL, reviews, table, themes
from reviewspark.catalogue.registry import query
from reviewspark.functions.arrays import field_of_each
from reviewspark.operators.aggregate import counts_by
from reviewspark.runtime import work_dir
from reviewspark.sources import damaged, labelled, long_json, raw_json, sinks
from reviewspark.sources import reviews as inputs

# Reviews per nested document, like the pages a collector stores.
_PAGE = 20


def _raw(spark, sf):
    """Nested documents built from the reviews: one per product and page of review ids.

    Every third page lacks prices and categories, every fifth reports a failure, and
    every seventh is no JSON at all.
    """
    rows = reviews(spark, sf).withColumn("page", F.floor(F.col("review_id") / (_PAGE * 20)))
    author = F.struct(
        F.col("review_id").cast("string").alias("steamid"), (F.col("votes_up") * 2).alias("playtime_forever")
    )
    review = F.struct(
        F.col("review_id").alias("id"),
        F.col("review_language").alias("language"),
        "review",
        "voted_up",
        "votes_up",
        (F.col("votes_up") / 8).cast("string").alias("weighted_vote_score"),
        author.alias("author"),
    )
    pages = rows.groupBy("app_id", "page").agg(F.sort_array(F.collect_list(review)).alias("reviews"))
    number = F.col("app_id") + F.col("page")
    some = number % 3 != 0
    named = lambda text: F.struct(F.lit(text).alias("description"))
    data = F.struct(
        F.concat(F.lit("Product "), "app_id").alias("name"),
        F.col("app_id").alias("steam_appid"),
        F.when(some, F.lit("16")).otherwise(F.lit("none")).alias("required_age"),
        F.when(some, F.struct(F.lit("9,99").alias("final_formatted"))).alias("price_overview"),
        F.when(some, F.array(named("Single"), named("Shared"))).alias("categories"),
        F.struct(F.lit(7).alias("total")).alias("achievements"),
        F.struct("reviews").alias("review_stats"),
    )
    product = F.struct((number % 5 != 0).alias("success"), data.alias("data"))
    text = F.to_json(F.map_from_arrays(F.array(F.col("app_id").cast("string")), F.array(product)))
    return pages.select(
        "app_id", "page", F.when(number % 7 == 0, F.concat(F.lit("<"), text)).otherwise(text).alias("value")
    )


_RAW_SQL = f"""{REVIEWS_SQL}, paged AS (SELECT *, review_id // {_PAGE * 20} AS page FROM reviews),
good AS (SELECT *, (app_id + page) % 3 <> 0 AS rich FROM paged
  WHERE (app_id + page) % 5 <> 0 AND (app_id + page) % 7 <> 0)"""


@query(f"""WITH {_RAW_SQL}
SELECT 'Product ' || app_id AS name, app_id::BIGINT AS steam_appid, CASE WHEN rich THEN 16 END::BIGINT AS required_age,
  CASE WHEN rich THEN '9,99' END AS price_overview, CASE WHEN rich THEN 'Single|Shared' ELSE '' END AS categories,
  7::BIGINT AS achievements, review_language, review_id::VARCHAR AS author_steamid,
  votes_up * 2 AS author_playtime_forever, review, voted_up, votes_up,
  votes_up / 8 AS weighted_vote_score FROM good""")
def json_flatten(spark, sf):
    flat = raw_json.flatten(raw_json.products(_raw(spark, sf)))
    return flat.select(
        "name", "steam_appid", "required_age", "price_overview",
        F.array_join("categories", "|").alias("categories"), "achievements", "review_language",
        "author_steamid", "author_playtime_forever", "review", "voted_up", "votes_up", "weighted_vote_score",
    )


@query(f"""WITH {_RAW_SQL}
SELECT app_id::BIGINT AS app_id, count(*)::INT AS total_num_reviews FROM good GROUP BY app_id, page""")
def child_array_size(spark, sf):
    return raw_json.review_totals(raw_json.products(_raw(spark, sf)))


@query(f"""WITH {_RAW_SQL}
SELECT app_id::BIGINT AS app_id, count(*) AS review_count, grouping(app_id)::INT AS is_total
FROM good GROUP BY ROLLUP (app_id)""")
def json_rollup_summary(spark, sf):
    return raw_json.conversion_summary(raw_json.flatten(raw_json.products(_raw(spark, sf))))


@query(f"""WITH {_RAW_SQL}
SELECT DISTINCT app_id, page, CASE WHEN (app_id + page) % 7 = 0 THEN 'not a document' ELSE 'no successful product' END AS reason
FROM paged WHERE (app_id + page) % 5 = 0 OR (app_id + page) % 7 = 0""")
def rejects_split(spark, sf):
    return raw_json.rejects(_raw(spark, sf)).select("app_id", "page", "reason")


@query("""SELECT event_id, TRY_CAST(props->>'$.k' AS DOUBLE) AS k, coalesce(props->>'$.missing', 'none') AS missing FROM events""")
def json_nested_defaults(spark, sf):
    parsed = table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k string, missing struct<deep:string>").alias("p")
    )
    return parsed.select(
        "event_id",
        F.col("p.k").try_cast("double").alias("k"),
        F.coalesce("p.missing.deep", F.lit("none")).alias("missing"),
    )


@query("""SELECT p_partkey, string_agg(upper(w), '|' ORDER BY i) AS words FROM (
  SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)
GROUP BY 1""")
def struct_field_lists(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.transform(F.split("p_name", " "), lambda w: F.struct(F.upper(w).alias("description"))).alias("c"),
    )
    return parts.select("p_partkey", F.array_join(field_of_each(F.col("c"), "description"), "|").alias("words"))


def _files(spark, sf):
    """Suppliers' line items as files: most rows name one product, some another one."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("file-"), "l_suppkey").alias("file"),
        (F.col("l_suppkey") % 19 + F.when(F.col("l_linenumber") > 5, 1).otherwise(0)).alias("steam_appid"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_returnflag")).alias("name"),
        F.col("l_linestatus").alias("title"),
    )


_FILES_SQL = """files AS (SELECT 'file-' || l_suppkey AS file, l_suppkey % 19 + CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END AS steam_appid,
  CASE WHEN l_suppkey % 3 = 0 THEN l_returnflag END AS name, l_linestatus AS title FROM lineitem),
id AS (SELECT file, steam_appid AS app_id FROM files GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, steam_appid) = 1),
n1 AS (SELECT file, name FROM files WHERE name IS NOT NULL GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, name) = 1),
n2 AS (SELECT file, title FROM files GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, title) = 1),
identity AS (SELECT file, app_id, coalesce(n1.name, n2.title) AS name FROM id LEFT JOIN n1 USING (file) LEFT JOIN n2 USING (file))"""


@query(f"WITH {_FILES_SQL} SELECT file, app_id, name FROM identity")
def product_identity(spark, sf):
    return inputs.file_identity(_files(spark, sf))


@query(f"""WITH {_FILES_SQL}, {THEMES_SQL}
SELECT app_id, file, name FROM identity WHERE app_id IN (SELECT app_id FROM themes)""")
def accepted_inputs(spark, sf):
    return inputs.accepted_files(inputs.file_identity(_files(spark, sf)), themes(spark))


@query(f"""WITH {_FILES_SQL}, {THEMES_SQL}
SELECT file, app_id, 'product has no themes' AS reason FROM identity WHERE app_id NOT IN (SELECT app_id FROM themes)""")
def skipped_inputs(spark, sf):
    rows = _files(spark, sf)
    return inputs.skipped_files(rows.select("file").distinct(), inputs.file_identity(rows), themes(spark))


@query(f"""WITH {_FILES_SQL}
SELECT f.file, f.steam_appid, count(*) AS n FROM files f JOIN identity i ON f.file = i.file AND f.steam_appid = i.app_id
GROUP BY ALL""")
def own_product_rows(spark, sf):
    rows = _files(spark, sf)
    return counts_by(inputs.own_rows(rows, inputs.file_identity(rows)), "file", "steam_appid")


@query("""WITH s AS (SELECT s_nationkey AS nation, s_name AS name, 0 AS source_no FROM supplier
  UNION ALL SELECT c_nationkey, c_name, 1 FROM customer)
SELECT nation, name, source_no FROM s QUALIFY source_no = min(source_no) OVER (PARTITION BY nation)""")
def source_priority(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    return inputs.first_source([suppliers, customers], "nation")


@query("""SELECT p_partkey AS appid, p_name AS name FROM part ORDER BY p_partkey""")
def catalogue_sorted(spark, sf):
    # Product list documents of at most 100 products.
    apps = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 100)).agg(
        F.collect_list(F.struct(F.col("p_partkey").alias("appid"), F.col("p_name").alias("name"))).alias("apps")
    )
    return raw_json.catalogue(apps.select(F.struct("apps").alias("applist")))


@query("""SELECT s_suppkey, s_name, s_acctbal, 'supplier' AS origin FROM supplier
UNION ALL SELECT c_custkey, c_name, c_acctbal, NULL FROM customer""")
def union_all_sources(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.lit("supplier").alias("origin"))
    customers = table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("s_acctbal"), F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")
    )
    return suppliers.unionByName(customers, allowMissingColumns=True)


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def sink_roundtrip_parquet(spark, sf):
    path = work_dir(spark, "products")
    sinks.write_products(table(spark, sf, "documents"), path, "lang")
    return spark.read.parquet(path).select("doc_id", "text", "lang", "n_chars")


def _listed(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", "url", "html", F.split("url", "/").alias("parts"), F.length("html").alias("n")
    )


_LISTED_SQL = "SELECT page_id, url, html, array_to_string(string_split(url, '/'), ' ; ') AS parts, length(html)::INT AS n FROM pages"
_LISTED_SCHEMA = "page_id bigint, url string, html string, parts string, n int"


@query(_LISTED_SQL)
def sink_roundtrip_csv(spark, sf):
    path = work_dir(spark, "report")
    sinks.write_csv(_listed(spark, sf), path)
    saved = sinks.read_report(spark, path, _LISTED_SCHEMA, ["parts"])
    return saved.withColumn("parts", F.array_join("parts", " ; "))


@query(_LISTED_SQL)
def sink_roundtrip_csv_quoted(spark, sf):
    path = work_dir(spark, "quoted")
    sinks.write_csv(_listed(spark, sf), path, quote_all=True)
    saved = sinks.read_csv(spark, path, _LISTED_SCHEMA, quote_all=True)
    return saved.withColumn("parts", F.array_join(F.from_json("parts", "array<string>"), " ; "))


@query("""SELECT p_brand AS topic, string_agg(term || ':' || w, ' ' ORDER BY w DESC, term) AS words FROM (
  SELECT p_brand, p_name AS term, count(*) AS w FROM part GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) <= 5) GROUP BY 1""")
def sink_roundtrip_json(spark, sf):
    from reviewspark.operators.keywords import top_terms

    named = counts_by(
        table(spark, sf, "part").select(F.col("p_brand").alias("topic"), F.col("p_name").alias("term")),
        "topic", "term", name="weight",
    )
    path = work_dir(spark, "words")
    sinks.write_topic_words(top_terms(named, ["topic"], 5), path)
    saved = spark.read.schema("topic string, words array<struct<word:string,score:bigint>>").json(path)
    shown = F.transform("words", lambda w: F.concat_ws(":", w["word"], w["score"].cast("string")))
    return saved.select("topic", F.array_join(shown, " ").alias("words"))


@query(f"SELECT {APP}::BIGINT AS app_id, count(*) AS total_reviews, true AS stamped FROM documents GROUP BY 1")
def manifest(spark, sf):
    rows = reviews(spark, sf).select(F.col("app_id").cast("bigint").alias("steam_appid"))
    return raw_json.manifest(rows).select(
        "app_id", "total_reviews", F.col("processed_at").isNotNull().alias("stamped")
    )


@query("""SELECT lang, count(*) AS n, 2::BIGINT AS n_rejected, count(*) AS in_footers, count(*) AS in_tops, count(*) AS rows_of_csv
FROM documents GROUP BY lang""")
def labelled_files(spark, sf):
    """Files with their counts in footers and top lines, next to what is read back from a folder with two damaged files."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text")
    folder, tops = work_dir(spark, "labelled"), work_dir(spark, "tops")
    labelled.write_labelled(rows, f"{folder}/good", "lang")
    labelled.write_labelled(rows, tops, "lang", kind="csv")
    # Two files of plain text among the Parquet files.
    for i in range(2):
        rows.filter(F.col("doc_id") == i).select(F.col("lang").alias("value")).coalesce(1).write.text(f"{folder}/bad{i}")

    read, rejects = damaged.read_undamaged(spark, folder, rows.schema)
    n = counts_by(read, "lang").withColumn("n_rejected", rejects.agg(F.count(F.lit(1))).scalar())

    def told(path, kind, name):
        pairs = labelled.read_labels(spark, path, kind).select(F.col("labels")["lang"].alias("lang"), F.col("labels")["total_reviews"].cast("long").alias("n"))
        return pairs.groupBy("lang").agg(F.sum("n").alias(name))

    back = counts_by(sinks.read_csv(spark, tops, "doc_id long, lang string, text string"), "lang", name="rows_of_csv")
    return n.join(told(f"{folder}/good", "parquet", "in_footers"), "lang").join(told(tops, "csv", "in_tops"), "lang").join(back, "lang")


@query(f"""WITH {_RAW_SQL}
SELECT app_id::BIGINT AS app_id, count(*) AS review_count, count(DISTINCT review_id) AS authors, sum(votes_up)::BIGINT AS votes,
  max(length(review))::INT AS longest, (SELECT count(DISTINCT (app_id, page)) FROM good g WHERE g.app_id = good.app_id) AS pages
FROM good GROUP BY app_id""")
def long_documents(spark, sf):
    """Nested files read as streams and cut at their reviews: what every product holds, and its documents."""
    folder = work_dir(spark, "nested")
    whole = _raw(spark, sf).filter("value not like '<%'")
    # An attribute that the flat table does not know.
    value = F.regexp_replace("value", '"data":[{]', '"data":{"page_note":"new",')
    whole.select("app_id", value.alias("value")).write.partitionBy("app_id").text(folder)
    scanned = long_json.scan(spark, folder)
    flat = raw_json.flatten(long_json.products(scanned))
    counts = flat.groupBy(F.col("steam_appid").alias("app_id")).agg(
        F.count(F.lit(1)).alias("review_count"), F.count_distinct("author_steamid").alias("authors"),
        F.sum("votes_up").alias("votes"), F.max(F.length("review")).alias("longest"))
    kept = long_json.extra_attributes(scanned).filter("attribute = 'page_note' and value = 'new'")
    # Products that report a failure keep their attributes, but have no reviews in the table.
    good = scanned.filter("kind = 'head' and text like '%\"success\":true%'").select(F.col("key").cast("bigint").alias("app_id"))
    pages = counts_by(good, "app_id", name="pages").join(kept.select("app_id").distinct(), "app_id", "left_semi")
    return counts.join(pages, "app_id")
