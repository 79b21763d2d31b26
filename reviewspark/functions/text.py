"""Cleaning, parsing and tokenising of text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as an emoji when text is cleaned.
EMOJI_RANGES = [
    ("1F600", "1F64F"),
    ("1F300", "1F5FF"),
    ("1F680", "1F6FF"),
    ("1F700", "1F77F"),
    ("1F780", "1F7FF"),
    ("1F800", "1F8FF"),
    ("1F900", "1F9FF"),
    ("1FA00", "1FA6F"),
    ("1FA70", "1FAFF"),
    ("2702", "27B0"),
    ("24C2", "257F"),
]
EMOJI_PATTERN = "[" + "".join(f"\\x{{{lo}}}-\\x{{{hi}}}" for lo, hi in EMOJI_RANGES) + "]+"

# All white space of Unicode, spelled out: as a plain class it is faster than (?U)\s.
SPACE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
URL_PATTERN = f"(?:http|www)[^{SPACE}]+"
SPACE_PATTERN = f"[{SPACE}]+"
# (?d) makes `.` stop at \n only.
TAG_PATTERN = r"(?d)<.*?>"
SYMBOL_PATTERN = f"[^a-zA-Z0-9{SPACE}]+"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL_PATTERN, "")


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI_PATTERN, "")


def squeeze_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE_PATTERN, " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG_PATTERN, "")


def strip_symbols(c: Column) -> Column:
    return F.regexp_replace(c, SYMBOL_PATTERN, "")


def clean_review(c: Column) -> Column:
    """Lower case, without links and emoji, single spaces; missing text becomes empty."""
    return squeeze_spaces(strip_emoji(strip_urls(F.lower(F.coalesce(c, F.lit(""))))))


def clean_markup(c: Column) -> Column:
    """Without tags, ASCII letters and digits only, single spaces; missing text stays missing."""
    return squeeze_spaces(strip_symbols(strip_tags(c)))


def clean_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`clean_markup` on those of the named columns that `df` has."""
    present = [n for n in names if n in df.columns]
    return df.withColumns({n: clean_markup(F.col(n).cast("string")) for n in present})


def long_enough(c: Column, least: int = 20) -> Column:
    return F.length(c) >= least


def preview(c: Column, most: int, one_line: bool = False) -> Column:
    """The first `most` characters, with an ellipsis when something was cut off."""
    c = F.replace(c, F.lit("\n"), F.lit(" ")) if one_line else c
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def product_label(app_id: Column, name: Column) -> Column:
    """`id - name`, or the id alone when there is no name."""
    return F.concat_ws(" - ", app_id.cast("string"), F.nullif(name, F.lit("")))


def leading_id(label: Column, separator: str = " - ") -> Column:
    """The integer before the first separator."""
    return F.split_part(label, F.lit(separator), F.lit(1)).try_cast("int")


def tokens(c: Column) -> Column:
    """Lower-case words of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))


def without(words: Column, stop_words: Iterable[str]) -> Column:
    """`words` without the stop words (kept in order, repeats kept)."""
    stop = list(stop_words)
    if not stop:
        return words
    return F.filter(words, lambda w: ~w.isin(stop))


def english_stop_words() -> list[str]:
    """Spark's own English list."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")
