"""Samples, chunks and merged lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewspark.catalogue.binding import VOTED_SQL, documents, table, voted_reviews
from reviewspark.catalogue.registry import query
from reviewspark.operators import ranking, sampling, summaries


def _hash_sql(key: str) -> str:
    return f"md5({key} || '-42')"


@query(f"""SELECT doc_id, lang FROM documents
WHERE CAST('0x' || substring({_hash_sql('doc_id')}, 1, 8) AS BIGINT) < (10 * 4294967296) // 100""")
def hash_sample(spark, sf):
    return sampling.fraction_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 10)


@query(f"""SELECT o_orderkey FROM orders WHERE CAST('0x' || substring({_hash_sql('o_orderkey')}, 1, 8) AS BIGINT)
  < (SELECT floor(least(1.0, 5000.0::DOUBLE / greatest(count(*), 1)) * 4294967296.0) FROM orders)""")
def sample_to_size(spark, sf):
    return sampling.sample_to_size(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5000)


@query(f"""SELECT l_suppkey, id, row_number() OVER (PARTITION BY l_suppkey ORDER BY h, id) AS sample_no FROM (
  SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS id, {_hash_sql('(l_orderkey * 8 + l_linenumber)')} AS h FROM lineitem)
QUALIFY sample_no <= 50""")
def capped_sample(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    )
    return sampling.sample_per_group(rows, ["l_suppkey"], "id", 50)


@query(f"""WITH {VOTED_SQL}, h AS (SELECT review_id, voted_up, {_hash_sql('review_id')} AS h FROM voted),
r AS (SELECT review_id, voted_up, row_number() OVER (PARTITION BY voted_up ORDER BY h, review_id) AS sample_no FROM h),
cap AS (SELECT least(40, 3 * least(20, count(*) FILTER (WHERE NOT voted_up))) AS c FROM voted)
SELECT review_id, voted_up, sample_no FROM r, cap WHERE sample_no <= CASE WHEN voted_up THEN c ELSE 20 END""")
def balanced_sample(spark, sf):
    rows = voted_reviews(spark, sf).select("review_id", "voted_up")
    return sampling.balanced_sample(
        rows, "voted_up", "review_id", most_negative=20, most_positive=40, times=3
    )


@query(f"""WITH {VOTED_SQL}, h AS (SELECT review_id, CASE WHEN voted_up THEN 'Like' ELSE 'Dislike' END AS sentiment,
  row_number() OVER (PARTITION BY voted_up ORDER BY {_hash_sql('review_id')}, review_id) AS sample_no FROM voted)
SELECT review_id, sentiment FROM h WHERE sample_no <= 30""")
def labelled_samples(spark, sf):
    rows = voted_reviews(spark, sf).select("review_id", "voted_up")
    side = lambda up, name: (
        sampling.sample_per_group(rows.filter(F.col("voted_up") == up), ["voted_up"], "review_id", 30)
        .select("review_id", F.lit(name).alias("sentiment"))
    )
    return side(True, "Like").unionByName(side(False, "Dislike"))


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_hash_sql('o_orderkey')}, o_orderkey LIMIT 1000")
def shuffle_take(spark, sf):
    return sampling.shuffled_head(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS row_no FROM documents)
SELECT lang, doc_id, row_no, (row_no - 1) // 40 AS chunk_no FROM r""")
def chunk_documents(spark, sf):
    return ranking.chunk_numbers(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 40)


@query("""WITH r AS (SELECT role, conv_id * 1000 + turn AS id, text,
  row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) AS row_no FROM conversations)
SELECT role, (row_no - 1) // 16 AS chunk_no, count(*)::INT AS chunk_size,
  string_agg(text, chr(10) || chr(10) ORDER BY row_no) AS chunk_text FROM r GROUP BY ALL""")
def chunk_texts(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return ranking.chunk_texts(turns, ["role"], "id", "text", 16)


@query("""WITH m AS (SELECT lang, avg(length(text)) AS m FROM documents GROUP BY 1)
SELECT lang, round(m, 6) AS mean_length, CASE WHEN m < 100 THEN 400 WHEN m > 500 THEN 100 ELSE 200 END::INT AS chunk_size FROM m""")
def adaptive_chunk_size(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "doc_id", "text")
    sizes = summaries.chunk_sizes(docs, ["lang"], "text", 200)
    return sizes.withColumn("mean_length", F.round("mean_length", 6))


@query("""WITH w AS (SELECT p_type, p_partkey, unnest(string_split(p_name, ' ')) AS w,
    generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
r AS (SELECT p_type, w, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey, i) - 1 AS pos FROM w)
SELECT p_type, pos // 25 AS chunk_no, string_agg(w, ' ' ORDER BY pos) AS words FROM r GROUP BY ALL""")
def merged_lists(spark, sf):
    pages = table(spark, sf, "part").select("p_type", "p_partkey", F.split("p_name", " ").alias("words"))
    merged = ranking.relist(pages, ["p_type"], "p_partkey", "words", 25)
    return merged.withColumn("words", F.array_join("words", " "))


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn")
def restored_order(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@query("""SELECT d.lang, s.part AS part, count(*) AS n FROM documents d,
  (SELECT unnest([0, 1]) AS part) s WHERE s.part = 0 OR length(d.text) > 500 GROUP BY ALL""")
def exploded_lists(spark, sf):
    parts = F.when(F.length("text") > 500, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = documents(spark, sf).select("lang", F.explode_outer(parts).alias("part"))
    return rows.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
