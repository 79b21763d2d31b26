"""The registered queries against their SQL, and those without SQL by row count."""

import pytest

from compare import compare
from reviewspark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, con, tiny):
    assert compare(spark, con, QUERIES[name], ORACLE[name], tiny) is None


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op5_toxicity", "op6_license_scan", "op7_simhash_components", "op8_sentencepiece",
                                  "op9_language_cnn", "op11_byte_bpe"])
def test_one_row_for_each_document(name, spark, con, tiny):
    got = sorted(r.doc_id for r in QUERIES[name](spark, tiny).select("doc_id").collect())
    assert got == [x for x, in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
