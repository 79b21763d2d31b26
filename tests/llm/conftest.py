import pytest

# Names that operators use inside, as extra columns of an input.
CLASH = ["_id", "_key", "_text", "_fp", "_part", "_at", "_w", "_starts", "_rid", "_rkey", "_h", "_n", "n_lines",
         "n_removed", "score", "component", "node", "label", "ids", "n_tokens", "similarity", "rank", "host", "rule"]
LONG = " ".join(f"word{i % 977} und{i % 13}" for i in range(60_000)) + "\nline\nline\nline\nline"


def odd_documents(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows, one id with two texts, clashing columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en"),
        (1, "the quick brown fox jumps over the lazy dog", "en"),
        (1, "another text under the same number", None),
        (2, None, "en"),
        (3, "", None),
        (4, " \n\t ", "de"),
        (5, LONG, "en"),
        (None, "no number here at all", "en"),
        (None, None, None),
        (6, "12 34 ### 56", "fr"),
        (7, "a\nb\nc\nd", "es"),
        (8, "a\nb\nc\nd", "es"),
        (9, "\u2581 mark \U0001f600 \x00 nul", "en"),
    ]
    extra = [None if i % 2 else f"x{i}" for i in range(len(CLASH))]
    return spark.createDataFrame(
        [(*r, "src", 3, *extra) for r in rows],
        ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{c}` string" for c in CLASH)]))


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
