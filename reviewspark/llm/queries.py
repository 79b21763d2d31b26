"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm import byte_bpe
from reviewspark.llm.centroids import centroid_clusters
from reviewspark.llm.common import table
from reviewspark.llm.line_dedup import dedup_lines
from reviewspark.llm.decontaminate import benchmark_hits
from reviewspark.llm.language_cnn import fit_languages, identify_languages
from reviewspark.llm.license_scan import scan_licences
from reviewspark.llm.passages import repeated_passages
from reviewspark.llm.pieces import PieceModel, encode_texts
from reviewspark.llm.simhash_dedup import simhash_components
from reviewspark.llm.spelling import count_words, spelling_variants
from reviewspark.llm.topk import exact_topk
from reviewspark.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from reviewspark.llm.url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

_RULES_SQL = ", ".join(
    f"('{word}', '{text}', '{text[: text.index('/')]}', '{text[text.index('/') :]}')" for word, text in URL_RULES
)


@query()
def op1_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share a passage of 50 words or more; clean documents have no row."""
    return repeated_passages(table(spark, sf, "documents"))


@query(f"""
WITH rules AS (SELECT * FROM (VALUES {_RULES_SQL}) r(word, rule, name, start)),
rest AS (SELECT row_number() OVER () AS row_no, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT row_no, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
named AS (SELECT *, host || regexp_replace(path, '/+$', '') AS name_ FROM parts),
lists AS (SELECT DISTINCT name_ FROM named JOIN labels ON labels.doc_id = page_id WHERE toxic = 1 AND name_ <> ''),
fits AS (
  SELECT any_value(n.page_id) AS page_id, any_value(n.host) AS host, any_value(n.path) AS path, any_value(n.name_) AS name_,
         arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.word, length(r.rule)) AS word
  FROM named n LEFT JOIN rules r
    ON (n.host = r.name OR ends_with(n.host, '.' || r.name)) AND starts_with(n.path, r.start)
  GROUP BY n.row_no)
SELECT page_id, host, path, rule,
       coalesce(word, CASE WHEN l.name_ IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       rule IS NULL AND l.name_ IS NOT NULL AS listed
FROM fits f LEFT JOIN lists l USING (name_)""")
def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page; the list holds the URLs of pages whose document is labelled toxic."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    return filter_urls(pages, pages.join(toxic, "page_id").select("url"), URL_RULES)


@query()
def op3_benchmark_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item; clean documents have no row."""
    return benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("_key")


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v) q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10""")
def op4_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return exact_topk(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query()
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    scored = score_toxicity(docs, fit_toxicity(docs, labels.filter(remainder(4) != 2)))
    return scored.select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query()
def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licences(table(spark, sf, "documents")).drop("spans")


@query()
def op7_simhash_components(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(table(spark, sf, "documents"))


@query()
def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents"), PieceModel.load())


@query()
def op9_language_cnn(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(remainder(5) != 0))
    return identify_languages(docs, model).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
windows AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM windows WHERE win IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM later, range(3) t(i)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text, len(string_split(d.text, chr(10))) AS n_lines,
       len(string_split(d.text, chr(10))) - coalesce(k.n, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)""")
def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


@query()
def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    model = byte_bpe.ByteBpe.load()
    ids = byte_bpe.encode_texts(table(spark, sf, "documents"), model, packed=True)
    data = byte_bpe.decode_ids(ids, model, keep=["n_tokens", "ids"])
    return data.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def _centroids_sql(k: int, rounds: int) -> str:
    """Unrolled rounds: centroids c0, c1, ..., assignments p0, p1, ..."""
    sql = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS cluster, e AS c FROM kept QUALIFY cluster < {k})"""
    for i in range(rounds + 1):
        sql += f""",
p{i} AS MATERIALIZED (
  SELECT rid, vec_id, e, cluster,
         CAST(list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c) AS BIGINT) AS distance
  FROM kept JOIN c{i} ON true QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)"""
        if i < rounds:
            sql += f""",
s{i} AS (
  SELECT cluster, dim, sum(CAST(x AS BIGINT)) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM p{i}) GROUP BY ALL),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY dim) AS c FROM s{i} GROUP BY cluster),
c{i + 1} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))"""
    return sql + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM p{rounds} JOIN c{rounds} USING (cluster)"""


@query(_centroids_sql(16, 3))
def op12_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster of every vector; a centroid is told by its digest."""
    members, centroids = centroid_clusters(table(spark, sf, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    # One row for each of the 16 centroids.
    side = centroids.select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
    return members.join(F.broadcast(side), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def lost_letter(doc_id: Column, run: Column) -> Column:
    """One of 199 runs, chosen by crc32 of `<doc_id>:<run>`, loses a code point."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


# crc32 byte by byte with its table; runs of the text; words one edit apart by the word without each of its letters.
_SPELLING_SQL = """
WITH RECURSIVE t AS (
  SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{6,}')) AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(
      range(0, strlen(id || ':' || run)), lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, t),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS short
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.short = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.short = b.word),
near AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
  FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
         CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
way AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms f ON way.next = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN way ON way.word = f.word AND way.next IS NULL"""


@query(_SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every frequent word with the more frequent word it is a variant of."""
    return spelling_variants(count_words(table(spark, sf, "documents"), edit=lost_letter))
