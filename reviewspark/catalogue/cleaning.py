"""Text cleaning, labels and list cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewspark.catalogue.binding import APP, documents, table
from reviewspark.catalogue.registry import query
from reviewspark.functions import arrays, numbers, text
from reviewspark.runtime import settle

# All white space of Unicode; RE2 knows only the ASCII part of \s.
_SPACE = (
    r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def _replaced(expression: str, *patterns: tuple[str, str]) -> str:
    for pattern, by in patterns:
        expression = f"regexp_replace({expression}, '{pattern}', '{by}', 'g')"
    return f"trim({expression})"


def _markup_sql(expression: str) -> str:
    return _replaced(
        expression, ("<.*?>", ""), (f"[^a-zA-Z0-9{_SPACE}]", ""), (f"[{_SPACE}]+", " ")
    )


def _review_sql(expression: str) -> str:
    link = f"http[^{_SPACE}]+|www[^{_SPACE}]+|https[^{_SPACE}]+"
    return _replaced(
        f"lower(coalesce({expression}, ''))",
        (link, ""), (text.EMOJI_PATTERN, ""), (f"[{_SPACE}]+", " "),
    )


@query(f"SELECT page_id, {_markup_sql('html')} AS clean FROM pages")
def clean_html(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", text.clean_markup(F.col("html")).alias("clean"))


@query(f"""WITH c AS (SELECT doc_id, {_review_sql('text')} AS clean FROM documents)
SELECT doc_id, clean FROM c WHERE length(clean) >= 20""")
def clean_text(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    cleaned = settle(docs, "clean", text.clean_review(F.col("text"))).drop("text")
    return cleaned.filter(text.long_enough(F.col("clean")))


@query(f"""SELECT page_id, {_markup_sql("'Site <b>' || url || '</b> & more'")} AS detailed_description,
       {_markup_sql('url')} AS short_description, {_markup_sql('html')} AS review FROM pages""")
def clean_multi(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.lit("Site <b>"), "url", F.lit("</b> & more")).alias("detailed_description"),
        F.col("url").alias("short_description"),
        F.col("html").alias("review"),
    )
    from reviewspark.schema import MARKUP_COLUMNS

    return text.clean_columns(pages, MARKUP_COLUMNS)


@query(f"""WITH l AS (SELECT doc_id, CASE WHEN lang = 'en' THEN {APP} || ' - ' || lang ELSE {APP}::VARCHAR END AS label FROM documents)
SELECT doc_id, label, TRY_CAST(split_part(label, ' - ', 1) AS INTEGER) AS app_id FROM l""")
def label_parse(spark, sf):
    app = F.regexp_extract("source", "[0-9]+", 0).try_cast("int")
    name = F.when(F.col("lang") == "en", F.col("lang"))
    labelled = table(spark, sf, "documents").select("doc_id", text.product_label(app, name).alias("label"))
    return labelled.withColumn("app_id", text.leading_id(F.col("label")))


@query("""SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END AS sample,
       CASE WHEN length(text) > 200 THEN replace(substring(text, 1, 200), chr(10), ' ') || '...'
            ELSE replace(text, chr(10), ' ') END AS one_line FROM documents""")
def truncate_preview(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.preview(t, 300).alias("sample"),
        text.preview(t, 200, one_line=True).alias("one_line"),
    )


@query("""SELECT p_partkey, CASE p_size % 5
    WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN replace(p_name, ' ', '|') || '|' || p_type
    WHEN 3 THEN p_name ELSE replace(p_name, ' ', '|') END AS items,
  CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN len(string_split(p_name, ' ')) + 1
    WHEN 3 THEN 1 ELSE len(string_split(p_name, ' ')) END::INT AS n FROM part""")
def list_cell_normalise(spark, sf):
    words = F.split("p_name", " ")
    quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
    kind = F.col("p_size") % 5
    cell = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, F.lit("  "))
        .when(kind == 2, F.concat(F.lit(" ["), quoted, F.lit(", None, \""), "p_type", F.lit("\"]")))
        .when(kind == 3, F.concat("p_name", F.lit("  ")))
        .otherwise(F.to_json(words))
    )
    parts = table(spark, sf, "part").withColumn("cell", cell)
    listed = parts.select("p_partkey", arrays.list_cell(F.col("cell")).alias("list"))
    return listed.select(
        "p_partkey", F.array_join("list", "|").alias("items"), F.size("list").alias("n")
    )


@query("""SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN text END, '') AS filled,
  CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars::DOUBLE END AS score,
  CASE WHEN toxic > 0 THEN quality / toxic ELSE 0 END::DOUBLE AS share,
  coalesce(quality, -1) AS quality
FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL""")
def null_handling(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    score = F.when(F.col("n_chars") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double"))
    return joined.filter(F.col("text").isNotNull()).select(
        "doc_id",
        F.coalesce(F.when(F.col("lang") == "en", F.col("text")), F.lit("")).alias("filled"),
        numbers.nan_to_null(score).alias("score"),
        numbers.ratio(F.col("quality"), F.col("toxic")).alias("share"),
        F.coalesce("quality", F.lit(-1)).alias("quality"),
    )
