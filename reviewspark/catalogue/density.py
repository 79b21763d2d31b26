"""Topics where vectors lie dense, with outliers, over all vectors and per product."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewspark.catalogue.binding import TOKENS, VECTORS_SQL, documents, vectors
from reviewspark.catalogue.registry import query
from reviewspark.operators.density import density_topics as dense_topics
from reviewspark.functions.text import tokens
from reviewspark.operators import keywords
from reviewspark.operators.density import least_size_by_volume, signed_sums, signed_words
from reviewspark.runtime import cut

_DIMS = 3
_SCALE = 1024
# At most so many levels are unrolled in the SQL; a level doubles the density.
_LEVELS = 12


_SUMS = ", ".join(
    f"list_sum(list_transform(embedding, lambda x, i: floor(x * {_SCALE})"
    f" * (CASE WHEN bit_count(CAST((i - 1) & {j} AS BIGINT)) % 2 = 0 THEN 1 ELSE -1 END)))" for j in range(1, _DIMS + 1))
_VECTOR_PLACES = VECTORS_SQL + f", places AS (SELECT vec_id, app_id, [{_SUMS}] AS spot FROM vectors)"
_SIGNED = ", ".join(f"sum(CASE WHEN substr(md5(term), {j}, 1) < '8' THEN tf ELSE -tf END)" for j in range(1, _DIMS + 1))
_TEXT_PLACES = f"""terms AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format("coalesce(text, '')")}) AS term FROM documents) GROUP BY ALL),
summed AS (SELECT doc_id, [{_SIGNED}] AS s, sqrt(sum(tf * tf)) AS len FROM terms GROUP BY doc_id),
places AS (
  SELECT doc_id AS vec_id, coalesce(list_transform(s, lambda x: floor(x * 1000 / len)), [0, 0, 0]) AS spot
  FROM documents LEFT JOIN summed USING (doc_id))"""


def _topics_sql(keys: list[str], side: int, least_density: int, least_size: str, places: str = _VECTOR_PLACES) -> str:
    """The tree of dense cells, unrolled level by level."""
    k = "".join(f"{x}, " for x in keys)
    same = lambda a, b: "".join(f" AND {a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in keys)
    near = lambda a, b: " AND ".join(f"abs({a}.cell[{i}] - {b}.cell[{i}]) <= 1" for i in range(1, _DIMS + 1))
    sql = places + f""", placed AS (
  SELECT vec_id, {k}list_transform(spot, lambda x: CAST(floor(x / {side}) AS BIGINT)) AS cell FROM places),
cells AS (SELECT {k}cell, count(*) AS mass FROM placed GROUP BY ALL),
sized AS (SELECT {k}sum(mass) AS n, {least_size} AS least FROM cells GROUP BY ALL),
density AS (
  SELECT {"".join(f"a.{x}, " for x in keys)}a.cell, any_value(a.mass) AS mass, sum(b.mass) AS density
  FROM cells a JOIN cells b ON {near("a", "b")}{same("a", "b")} GROUP BY ALL),
top AS (SELECT *, length(bin(CAST(density // {least_density} AS BIGINT))) - 1 AS top FROM density WHERE density >= {least_density}),
node0 AS (SELECT {k}level, cell, mass FROM top, range({_LEVELS}) r(level) WHERE level <= top),
reach AS (
  SELECT {k}level, cell, cell AS other FROM node0
  UNION SELECT {"".join(f"r.{x}, " for x in keys)}r.level, r.cell, n.cell
  FROM reach r JOIN node0 n ON r.level = n.level AND {near("n", "r").replace("r.cell", "r.other")}{same("r", "n")}),
node AS (
  SELECT {"".join(f"n.{x}, " for x in keys)}n.level, n.cell, any_value(n.mass) AS mass, min(r.other) AS branch
  FROM node0 n JOIN reach r ON n.level = r.level AND n.cell = r.cell{same("n", "r")} GROUP BY ALL),
size AS (
  SELECT {"".join(f"n.{x}, " for x in keys)}level, branch, sum(mass) AS size FROM node n
  JOIN sized s ON true{same("n", "s")} GROUP BY ALL HAVING sum(mass) >= any_value(s.least)),
tree AS (
  SELECT s.*, n.branch AS up, count(*) OVER (PARTITION BY {"".join(f"s.{x}, " for x in keys)}s.level, n.branch) > 1 OR n.branch IS NULL AS heads
  FROM size s LEFT JOIN node n ON n.level = s.level - 1 AND n.cell = s.branch{same("n", "s")}),
h0 AS (SELECT {k}level, branch, size, up, level AS head_level, branch AS head FROM tree WHERE level = 0)"""
    for i in range(1, _LEVELS):
        sql += f""",
h{i} AS (
  SELECT {"".join(f"t.{x}, " for x in keys)}t.level, t.branch, t.size, t.up, CASE WHEN heads THEN t.level ELSE h.head_level END AS head_level,
         CASE WHEN heads THEN t.branch ELSE h.head END AS head
  FROM tree t JOIN h{i - 1} h ON t.up = h.branch{same("t", "h")} WHERE t.level = {i})"""
    sql += ", headed AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(_LEVELS)) + f"""),
gain AS (SELECT {k}head_level, head, sum(size) AS gain FROM headed GROUP BY ALL),
inside AS (
  SELECT {"".join(f"g.{x}, " for x in keys)}g.head_level, g.head, g.gain, p.head_level AS from_level, p.head AS from_head
  FROM gain g JOIN headed t ON t.level = g.head_level AND t.branch = g.head{same("t", "g")}
  LEFT JOIN headed p ON p.level = t.level - 1 AND p.branch = t.up{same("p", "t")})"""
    for i in reversed(range(_LEVELS)):
        below = " UNION ALL ".join(
            f"SELECT {k}from_level, from_head, best FROM b{j} WHERE from_level = {i}" for j in range(i + 1, _LEVELS))
        below = below or f"SELECT {k}from_level, from_head, 0 AS best FROM inside WHERE false"
        sql += f""",
b{i} AS MATERIALIZED (
  SELECT g.*, greatest(gain, coalesce(x.best, 0)) AS best, gain >= coalesce(x.best, 0) AS kept
  FROM inside g LEFT JOIN (SELECT {k}from_head, sum(best) AS best FROM ({below}) GROUP BY ALL) x
    ON g.head = x.from_head{same("g", "x")} WHERE g.head_level = {i})"""
    kept = " UNION ALL ".join(f"SELECT {k}head_level, head FROM b{i} WHERE kept" for i in range(_LEVELS))
    return sql + f""",
core AS (
  SELECT {"".join(f"n.{x}, " for x in keys)}n.cell, min({{'l': h.head_level, 'h': h.head}}) AS cluster
  FROM node n JOIN headed h ON n.level = h.level AND n.branch = h.branch{same("n", "h")}
  JOIN ({kept}) k ON k.head_level = h.head_level AND k.head = h.head{same("k", "h")} GROUP BY ALL),
beside AS (
  SELECT {"".join(f"d.{x}, " for x in keys)}d.cell, c.cluster FROM density d
  JOIN core c ON {near("d", "c")}{same("d", "c")} JOIN density e ON e.cell = c.cell{same("e", "c")}
  WHERE NOT EXISTS (SELECT 1 FROM core o WHERE o.cell = d.cell{same("o", "d")})
  QUALIFY row_number() OVER (PARTITION BY {"".join(f"d.{x}, " for x in keys)}d.cell ORDER BY
    {" + ".join(f"(d.cell[{i}] - c.cell[{i}]) ** 2" for i in range(1, _DIMS + 1))}, e.density DESC, c.cluster) = 1),
labelled AS (SELECT {k}cell, cluster FROM core UNION ALL SELECT {k}cell, cluster FROM beside),
numbered AS (
  SELECT {"".join(f"l.{x}, " for x in keys)}cluster, row_number() OVER (
    {"PARTITION BY " + ", ".join(f"l.{x}" for x in keys) if keys else ""} ORDER BY sum(mass) DESC, cluster) - 1 AS topic
  FROM labelled l JOIN cells c ON l.cell = c.cell{same("l", "c")} GROUP BY {"".join(f"l.{x}, " for x in keys)}cluster)
SELECT {"".join(f"p.{x}, " for x in keys)}vec_id, CAST(coalesce(topic, -1) AS INTEGER) AS topic
FROM placed p LEFT JOIN labelled l ON l.cell = p.cell{same("l", "p")}
LEFT JOIN numbered n ON n.cluster = l.cluster{same("n", "l")}"""


@query("WITH RECURSIVE " + _topics_sql([], 400, 16, "20"))
def density_topics(spark, sf):
    """Topics of all vectors, of 20 or more; the others are outliers."""
    points = vectors(spark, sf).select("vec_id", signed_sums(F.col("embedding"), _DIMS, _SCALE).alias("at"))
    return dense_topics(points, "vec_id", "at", [], _DIMS, 400, 16, F.lit(20))


# The tables hold far fewer vectors a product than the reviews the published sizes are for.
@query("WITH RECURSIVE " + _topics_sql(["app_id"], 700, 4, "CASE WHEN sum(mass) > 30 THEN 10 ELSE 4 END"))
def density_topics_per_product(spark, sf):
    """Topics of every product in the same jobs, with a least size by the product's volume."""
    points = vectors(spark, sf).select("app_id", "vec_id", signed_sums(F.col("embedding"), _DIMS, _SCALE).alias("at"))
    least = least_size_by_volume(large=30, of_large=10, of_others=4)
    return dense_topics(points, "vec_id", "at", ["app_id"], _DIMS, 700, 4, least)


_TEXT_TOPICS = "WITH RECURSIVE " + _topics_sql([], 350, 16, "20", _TEXT_PLACES)


def _text_topics(spark, sf):
    words = tokens(F.coalesce("text", F.lit("")))
    points = documents(spark, sf).select("doc_id", signed_words(words, _DIMS).alias("at"))
    return dense_topics(points, "doc_id", "at", [], _DIMS, 350, 16, F.lit(20))


@query(f"SELECT vec_id AS doc_id, topic FROM ({_TEXT_TOPICS})")
def density_topics_of_texts(spark, sf):
    """Topics of all texts by the words they use, of 20 or more; the others are outliers."""
    return _text_topics(spark, sf)


@query(f"""WITH topics AS (SELECT vec_id AS doc_id, topic FROM ({_TEXT_TOPICS})),
w AS (SELECT topic, unnest({TOKENS.format("text")}) AS term FROM documents JOIN topics USING (doc_id) WHERE text IS NOT NULL),
tf AS (SELECT topic, term, count(*) AS tf FROM w GROUP BY ALL),
size AS (SELECT topic, sum(tf) AS words FROM tf GROUP BY 1),
uses AS (SELECT term, sum(tf) AS uses FROM tf GROUP BY 1),
weights AS (
  SELECT topic, term, round(tf / words * ln(1 + (SELECT avg(words) FROM size) / uses), 9) AS weight
  FROM tf JOIN size USING (topic) JOIN uses USING (term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM weights)
SELECT topic, term, round(weight, 6) AS weight, rank FROM ranked WHERE rank <= 5""")
def density_topic_words(spark, sf):
    """The five words that stand for each topic of the texts, and for the outliers."""
    topics = cut(_text_topics(spark, sf))
    docs = documents(spark, sf).select("doc_id", "text").join(topics, "doc_id")
    top = keywords.top_terms(keywords.class_tfidf_weights(docs, "topic", "text"), ["topic"], 5)
    return top.select("topic", "term", F.round("weight", 6).alias("weight"), F.col("rank").cast("long").alias("rank"))
