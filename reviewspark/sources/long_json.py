"""Nested documents of any size: files are read as streams and cut at the reviews inside them.

`read_raw` makes a whole file one value. Here a file passes through its task once, block by
block; what comes out are the reviews in portions of about a megabyte and, for each product,
its document without them. Portions are parsed and flattened by as many tasks as they fill.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.runtime import cut
from reviewspark.schema import RAW_DOCUMENT
from reviewspark.sources.damaged import listed_files
from reviewspark.sources.labelled import place
from reviewspark.sources.raw_json import usable

# Bytes read at a time, and bytes of reviews that make a portion.
BLOCK = 4 << 20
PORTION = 1 << 20
# Where the reviews of a product stand in its document.
REVIEWS_AT = [b"data", b"review_stats", b"reviews"]

# A string, with the colon that makes it a key; a bracket; a quote whose string goes on beyond the block.
_TOKEN = re.compile(rb'"((?:[^"\\]|\\.)*)"(\s*:)?|[{}\[\]]|"', re.DOTALL)
_SCAN = "file string, number int, key string, part int, kind string, text string"


class Broken(ValueError):
    """What is read is no sequence of documents."""


def pieces(stream: BinaryIO, block: int = BLOCK, portion: int = PORTION) -> Iterator[tuple[int, bytes, int, str, bytes]]:
    """(number, product key, part, kind, JSON) of the products in a stream of documents, one after the other.

    Kind `reviews` is a list of reviews, kind `head` the product with an empty list in their
    place; a product's head comes after its reviews. No more than a block, a portion, a head
    and a review are held.
    """
    opened: list[int] = []  # brackets that are open
    keys: list[bytes | None] = []  # the last key in each of them
    number, part, held = -1, 0, 0
    head: list[bytes] = []
    review: list[bytes] = []
    reviews: list[bytes] = []
    in_product = in_list = in_review = False
    buffer, size = b"", block
    while True:
        more = stream.read(size)
        buffer, final = buffer + more, not more
        since = 0  # where in the buffer the head or the review goes on
        after = 0  # behind the last token
        for m in _TOKEN.finditer(buffer):
            at, end, token = m.start(), m.end(), buffer[m.start()]
            if token == 34:
                if (m.group(1) is None or end == len(buffer)) and not final:
                    break
                if m.group(1) is None:
                    raise Broken("a string does not end")
                if not opened:
                    raise Broken("text outside of a document")
                if m.group(2) is not None:
                    keys[-1] = m.group(1)
            elif token in b"{[":
                if not opened and (token != 123 or buffer[after:at].strip()):
                    raise Broken("text outside of a document")
                if len(opened) == 1:
                    in_product, since, head, number, part = True, at, [], number + 1, 0
                elif in_list and len(opened) == 5:
                    in_review, since, review = True, at, []
                opened.append(token)
                keys.append(None)
                if token == 91 and len(opened) == 5 and keys[1:4] == REVIEWS_AT and not in_list:
                    in_list = True
                    head.append(buffer[since:end])
            else:
                if not opened or opened.pop() != token - 2:
                    raise Broken("brackets do not match")
                keys.pop()
                if in_list and len(opened) == 4:
                    in_list, since = False, at
                elif in_review and len(opened) == 5:
                    in_review = False
                    reviews.append(b"".join([*review, buffer[since:end]]))
                    held += len(reviews[-1])
                    if held >= portion:
                        yield number, keys[0] or b"", part, "reviews", b"[" + b",".join(reviews) + b"]"
                        reviews, held, part = [], 0, part + 1
                elif len(opened) == 1 and in_product:
                    if reviews:
                        yield number, keys[0] or b"", part, "reviews", b"[" + b",".join(reviews) + b"]"
                        reviews, held = [], 0
                    yield number, keys[0] or b"", 0, "head", b"".join([*head, buffer[since:end]])
                    in_product = False
            after = end
        if final:
            if opened:
                raise Broken("a document does not end")
            if buffer[after:].strip():
                raise Broken("text outside of a document")
            return
        # What follows the last token is looked at again with the next block.
        if in_review:
            review.append(buffer[since:after])
        elif in_product and not in_list:
            head.append(buffer[since:after])
        if not opened and buffer[after:].strip(b" \t\r\n")[:1] not in (b"", b"{", b'"'):
            raise Broken("text outside of a document")
        # A string longer than a block is read on in ever larger steps.
        size = max(block, len(buffer) - after) if len(buffer) - after >= block else block
        buffer = buffer[after:]


def scan(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, number, key, part, kind, text) of all files under `path`, written to the shared folder.

    A file that is no sequence of documents adds one row of kind `broken` with the reason;
    what stands before the fault is there as well, and `products` leaves it out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                files, at = place(file)
                try:
                    with files.open_input_stream(at) as stream:
                        for number, key, part, kind, text in pieces(stream):
                            yield _row(file, number, key.decode("utf-8", "replace"), part, kind, text.decode("utf-8", "replace"))
                except (Broken, OSError) as e:
                    yield _row(file, None, None, None, "broken", str(e))

    # The rebalance deals the portions of a large file out to many tasks.
    return cut(listed_files(spark, path, pattern).select("file").mapInArrow(run, _SCAN).hint("rebalance"))


def _row(*values) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["file", "number", "key", "part", "kind", "text"])


def rejects(scanned: DataFrame) -> DataFrame:
    """(file, reason) of the files that are no sequence of documents."""
    return scanned.filter("kind = 'broken'").select("file", F.col("text").alias("reason"))


def _whole(scanned: DataFrame, kind: str) -> DataFrame:
    return scanned.filter(F.col("kind") == kind).join(rejects(scanned).select("file"), "file", "left_anti")


def products(scanned: DataFrame) -> DataFrame:
    """(app_id, data) as `raw_json.products` gives them, but a row for each portion of a product's reviews.

    `raw_json.flatten` turns them into the flat table. Products that report a failure, carry
    no data or no reviews have no row, nor have the files that are broken.
    """
    one = RAW_DOCUMENT.valueType
    review = one["data"].dataType["review_stats"].dataType["reviews"].dataType
    heads = _whole(scanned, "head").select("file", "number", "key", F.from_json("text", one).alias("product"))
    heads = heads.filter(usable(F.col("product"))).select("file", "number", "key", F.col("product.data").alias("data"))
    lists = _whole(scanned, "reviews").select("file", "number", F.from_json("text", review).alias("reviews"))
    return lists.join(heads, ["file", "number"]).select(
        F.col("key").try_cast("bigint").alias("app_id"),
        F.col("data").withField("review_stats", F.struct("reviews")).alias("data"))


def extra_attributes(scanned: DataFrame) -> DataFrame:
    """(app_id, attribute, value): what the products carry besides the known attributes, as JSON text."""
    known = RAW_DOCUMENT.valueType["data"].dataType.fieldNames()
    parsed = F.from_json("text", "data map<string, string>")["data"]
    return _whole(scanned, "head").select(
        F.col("key").try_cast("bigint").alias("app_id"),
        F.explode(F.map_filter(parsed, lambda k, v: ~k.isin(known))).alias("attribute", "value"))
