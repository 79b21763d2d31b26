"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import stored
from reviewspark.runtime import broadcast_if_small

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# One block is one 64-bit word; this many bits are set for a URL, and this many are spent on one.
PROBES = 5
BITS_PER_URL = 16


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without scheme, query, fragment and closing slashes."""
    return F.concat(host, F.regexp_replace(path, "/+$", ""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    A rule is (verdict, "host/path"); it fits its host and the host's subdomains where the
    path starts with the rule's path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _probe(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block number and the bits set in it."""
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"),
                                              F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")))
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)), mask

# Numbers of blocks that do not exist, among which pages without a look-up are spread.
SPREAD = 4096


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table (_block, _word): every listed key sets its bits in one word."""
    block, mask = _probe(F.col(key), blocks)
    return listed.select(block.alias("_block"), mask.alias("_mask")).groupBy("_block").agg(
        F.bit_or("_mask").alias("_word"))


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    listed_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every page.

    The longest fitting rule decides. Where none fits, a page whose canonical URL is in
    `listed` is blocked and any other allowed. Only URLs that no rule decides and that the
    Bloom filter passes reach the exact join, so its false positives change nothing. The
    filter's words are broadcast if they measure up to the limit and joined by block
    otherwise; the exact join is left to the planner, whose adaptive form splits a URL that
    very many pages share.
    A null URL, or one without `://`, has empty host and path, fits no rule, is never
    listed and is allowed. Repeated pages stay repeated, repeated or null listed URLs
    count once or not at all, an empty list allows what no rule blocks.
    """
    url = F.col(listed_col)
    names = listed.select(canonical(url_host(url), url_path(url)).alias("_name")).filter("_name <> ''").distinct()
    names = stored(names, "listed")
    blocks = max(1, names.count() * BITS_PER_URL // 64)
    words = stored(bloom_blocks(names, "_name", blocks), "bloom")

    u = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), url_host(u).alias("host"), url_path(u).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("_said"), canonical(F.col("host"), F.col("path")).alias("_name"))
    block, mask = _probe(F.col("_name"), blocks)
    open_ = F.col("rule").isNull() & (F.col("_name") != "")
    # Pages that a rule decides meet no word; numbers of their own spread them where the join shuffles.
    none = F.lit(-1) - F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SPREAD)).cast("int")
    base = base.select("*", F.when(open_, block).otherwise(none).alias("_block"), mask.alias("_mask"))
    small = broadcast_if_small(words, F.lit(24))
    tried = base.join(small, "_block", "left").withColumn(
        "_hit", F.coalesce(F.col("_word").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
    exact = broadcast_if_small(names, F.length("_name") * 2 + 32).withColumn("listed", F.lit(True))
    hits = tried.filter("_hit").join(exact, "_name", "left")
    passed = tried.filter(~F.col("_hit")).withColumn("listed", F.lit(None).cast("boolean"))
    both = hits.select(*passed.columns).unionByName(passed)
    found = F.coalesce("listed", F.lit(False))
    return both.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_said", F.when(found, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        found.alias("listed"),
    )
