"""Expressions on list cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewspark.functions.text import SPACE

_LENIENT = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value worked out once per row.

    The optimiser copies an expression into a lambda that mentions it, where it would be
    worked out again for every element; a lambda variable is not copied.
    """
    return F.get(F.transform(F.array(value), body), 0)


def list_cell(c: Column) -> Column:
    """A text cell that may hold a printed list, as `array<string>`.

    Missing or blank gives no elements, `[...]` is parsed and loses its nulls, any
    other text (also brackets that do not parse) is one element.
    """
    text = F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")
    parsed = F.from_json(_as_json(text), "array<string>", _LENIENT)
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(text.startswith("[") & text.endswith("]") & parsed.isNotNull(), drop_nulls(parsed))
        .otherwise(F.array(text))
    )


# A quoted element of a printed list; the group keeps it.
_QUOTED = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
# Stands for a character that a list may not hold, while its words are looked at.
_MARK = "\x01"


def _as_json(text: Column) -> Column:
    r"""A printed list as JSON: bare None, True and False, and the escapes \xNN and \UNNNNNNNN."""
    # Quoted elements are matched first and come back as they are; a bare word gets a mark.
    out = F.regexp_replace(text, _QUOTED + r"|\b(None|True|False)\b", f"$1{_MARK}$2{_MARK}")
    for word, json in (("", ""), ("None", "null"), ("True", '"True"'), ("False", '"False"')):
        out = F.replace(out, F.lit(f"{_MARK}{word}{_MARK}"), F.lit(json))
    out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    return _wide_escapes(out)


def _wide_escapes(text: Column) -> Column:
    r"""\UNNNNNNNN as the two halves that JSON writes it in."""
    pieces = F.split(text, r"(?<!\\)(?=(?:\\\\)*\\U[0-9a-fA-F]{8})")

    def half(code: Column) -> Column:
        over = code - 0x10000
        return F.concat(
            F.lit("\\u"), F.lpad(F.hex(F.lit(0xD800) + F.shiftright(over, 10)), 4, "0"),
            F.lit("\\u"), F.lpad(F.hex(F.lit(0xDC00) + over.bitwiseAND(0x3FF)), 4, "0"))

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^(?:\\\\)*\\U([0-9a-fA-F]{8})", 1)
        code = F.conv(digits, 16, 10).cast("int")
        short = F.concat(F.lit("\\u"), F.substring(digits, 5, 4))
        return F.when(digits == "", p).otherwise(
            F.concat(F.regexp_extract(p, r"^((?:\\\\)*)\\U", 1), F.when(code < 0x10000, short).otherwise(half(code)),
                     F.regexp_replace(p, r"^(?:\\\\)*\\U[0-9a-fA-F]{8}", "")))

    return F.array_join(F.transform(pieces, one), "")


def drop_nulls(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull())


def field_of_each(c: Column, field: str) -> Column:
    """One field out of a list of structs; a missing list becomes an empty one."""
    return F.coalesce(F.transform(c, lambda x: x[field]), F.array().cast("array<string>"))


def join_text(c: Column, separator: str = ", ") -> Column:
    return F.array_join(c, separator)


# So many elements of a batch are worked on at once: what a task holds does not follow its texts.
SLICE_ELEMENTS = 200_000


def in_slices(lists: pa.ListArray, most: int = SLICE_ELEMENTS) -> Iterator[pa.ListArray]:
    """A batch of lists in order, in slices of at most `most` elements or of one list."""
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lists.slice(start, end - start)
        start = end


def counted_terms(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term and uses for each row and distinct word, in that order, and the terms in order."""
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    width = max(1, len(order))
    sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    owners = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    pairs, uses = np.unique(owners * width + rank[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    row, term = np.divmod(pairs, width)
    return row, term, uses, coded.dictionary.take(pa.array(order))


def as_lists(row: np.ndarray, rows: int, **fields: pa.Array) -> pa.ListArray:
    """Entries in the order of their rows as one list of structs a row."""
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=rows)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def count_terms(words: Column) -> Column:
    """array<struct<term, tf>> of a list of words, terms in order; a missing list has none.

    Words are counted in Arrow batches, a slice at a time, so no shuffle is needed and a long
    text costs n log n.
    """

    @F.arrow_udf("array<struct<term: string, tf: int>>")
    def counted(batch: pa.Array) -> pa.Array:
        done = []
        for lists in in_slices(batch):
            row, term, uses, terms = counted_terms(lists)
            done.append(as_lists(row, len(lists), term=terms.take(pa.array(term)), tf=pa.array(uses, pa.int32())))
        return pa.concat_arrays(done) if done else pa.nulls(0, _TERMS)

    return counted(words)


_TERMS = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
