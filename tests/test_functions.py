import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewspark.functions import arrays, numbers, text, vectors


def column(spark, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i int, x {kind}")


def apply(spark, fn, values, kind="string"):
    df = column(spark, values, kind).select("i", fn(F.col("x")).alias("y"))
    return [r.y for r in df.orderBy("i").collect()]


def test_markup_edges(spark):
    raw = ["<a\rb>x", "<a\nb>x", "a b", "café \U0001f600!", "  a \t b ", None, ""]
    assert apply(spark, text.clean_markup, raw) == ["x", "a bx", "a b", "caf", "a b", None, ""]


def test_review_edges(spark):
    raw = ["See HTTP://x.y/z now", "www.x a", "a\U0001f680b", "✂ cut", None, "A　B", "xhttps://q"]
    assert apply(spark, text.clean_review, raw) == ["see now", "a", "ab", "cut", "", "a b", "x"]


def test_space_class_is_all_unicode_space(spark):
    spaces = [chr(c) for c in range(0x110000) if re.match(r"\s", chr(c)) and not 0x1C <= c <= 0x1F]
    assert set(apply(spark, text.squeeze_spaces, [f"a{s}b" for s in spaces])) == {"a b"}


def test_preview_edges(spark):
    got = apply(spark, lambda c: text.preview(c, 300), ["x" * 300, "x" * 301, None])
    assert got == ["x" * 300, "x" * 300 + "...", None]
    assert apply(spark, lambda c: text.preview(c, 9, one_line=True), ["a\nb"]) == ["a b"]


def test_labels(spark):
    df = spark.createDataFrame([(7, "Name - x"), (8, ""), (9, None)], "id int, name string")
    label = text.product_label(F.col("id"), F.col("name"))
    rows = df.select(label.alias("l"), text.leading_id(label).alias("b")).collect()
    assert [(r.l, r.b) for r in rows] == [("7 - Name - x", 7), ("8", 8), ("9", 9)]
    assert apply(spark, lambda c: text.leading_id(c, "_"), ["12_data", "x_1"]) == [12, None]


def test_list_cells(spark):
    cells = [None, "", "  ", "[]", "['a', 'b']", '["it\'s", None, "x"]', "plain", "[broken", "[a b]"]
    assert apply(spark, arrays.list_cell, cells) == [
        [], [], [], [], ["a", "b"], ["it's", "x"], ["plain"], ["[broken"], ["[a b]"],
    ]


def test_counted_terms(spark):
    got = apply(spark, lambda c: arrays.count_terms(text.tokens(c)), ["b a bb aa bb", "", None])
    assert [(r.term, r.tf) for r in got[0]] == [("aa", 1), ("bb", 2)]
    assert got[1] == []


def test_field_of_each(spark):
    df = spark.sql("select null c union all select array(named_struct('description', 'x')) c")
    got = df.select(arrays.field_of_each(F.col("c"), "description").alias("d")).collect()
    assert sorted(r.d for r in got) == [[], ["x"]]


@pytest.mark.parametrize("part,whole,shown", [(1, 16, "6.2%"), (1, 32, "3.1%"), (0, 0, "0.0%"), (1, 1, "100.0%"), (1, 3, "33.3%")])
def test_percent(spark, part, whole, shown):
    df = spark.createDataFrame([(part, whole)], "p bigint, w bigint")
    assert df.select(numbers.percent_text(F.col("p"), F.col("w")).alias("t")).first().t == shown
    assert shown == (f"{part / whole * 100:.1f}%" if whole else "0.0%")


def test_buckets_and_bins(spark):
    sizes = [9_999, 10_000, 50_000, 50_001]
    assert apply(spark, numbers.volume_bucket, sizes, "bigint") == ["small", "medium", "medium", "large"]
    hours = [0.0, 998.0, 998.5, 999.0, 999.5, 1000.0, -1.0]
    assert apply(spark, lambda c: numbers.unit_bin(c, 999), hours, "double") == [0, 998, 998, 998, None, None, None]
    assert apply(spark, lambda c: numbers.adaptive_chunk(c, 200), [99.0, 100.0, 500.0, 501.0], "double") == [400, 200, 200, 100]


def test_nan_and_ratio(spark):
    assert apply(spark, numbers.nan_to_null, [float("nan"), 1.0, None], "double") == [None, 1.0, None]
    assert apply(spark, lambda c: numbers.ratio(F.lit(1), c), [0, 2, None], "int") == [0.0, 0.5, 0.0]


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.cosine(vectors.dot(a, b), vectors.norm(a), vectors.norm(b)).alias("s")).collect()
    assert [round(r.s, 9) for r in got] == [0.0, 1.0]
    assert apply(spark, vectors.first_best, [[1.0, 3.0, 3.0], [0.0]], "array<double>") == [1, 0]


@pytest.mark.parametrize("cell, want", [
    ("['a, None, b']", ["a, None, b"]),
    ("['None', None, \"it's\"]", ["None", "it's"]),
    ("[True, 'x', \"y, False\", False]", ["True", "x", "y, False", "False"]),
    (r"['caf\xa0e']", ["caf\xa0e"]),
    (r"['\U0001f600 \\x41', '\U000000e9']", ["\U0001f600 \\x41", "é"]),
    (r"['a\'b None, True', None]", ["a'b None, True"]),
    ("[ None ]", []),
])
def test_printed_lists(spark, cell, want):
    assert apply(spark, arrays.list_cell, [cell]) == [want]


def test_lists_in_slices():
    lists = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c", "d"], ["e"] * 3], pa.list_(pa.string()))
    for whole in (lists, lists.slice(1, 4)):
        cut_up = list(arrays.in_slices(whole, 4))
        assert [x for part in cut_up for x in part.to_pylist()] == whole.to_pylist()
        assert all(len(part) == 1 or len(part.flatten()) <= 4 for part in cut_up)
    assert list(arrays.in_slices(lists.slice(0, 0), 4)) == []
