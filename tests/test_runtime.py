"""Dealing out small inputs, deleting intermediate tables, and the entry without the training-data operators."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from reviewspark.runtime import cut, deal_out, discard

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_small_inputs_are_dealt_out_and_large_ones_are_not(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    dealt = deal_out(docs, part=32 * 1024)
    assert dealt.rdd.getNumPartitions() > docs.rdd.getNumPartitions()
    assert sorted(dealt.select("doc_id").collect()) == sorted(docs.select("doc_id").collect())
    assert deal_out(docs, limit=10) is docs
    # Columns and filters still reach the scan.
    plan = dealt.filter("lang = 'en'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1] and "EqualTo(lang,en)" in plan


def test_discarded_tables_are_gone(spark):
    kept, gone = cut(spark.range(5)), cut(spark.range(7))
    discard(gone)
    assert not os.path.exists(gone._cut_at.removeprefix("file:")) and kept.count() == 5
    with pytest.raises(AttributeError):
        discard(spark.range(3).filter(F.col("id") > 1))


@pytest.mark.parametrize("missing", ["reviewspark.llm", "reviewspark.llm.queries", "corpus_pipeline"])
def test_entry_without_a_part(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), any(k[:2] == 'op' and k[2].isdigit() for k in e.queries()), 'pipeline' in e.queries())")
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=100)
    assert out.returncode == 0, out.stderr
    n, operators, pipeline = out.stdout.split()
    there = missing == "corpus_pipeline" and os.path.exists(f"{REPO}/reviewspark/llm/queries.py")
    assert int(n) > 90 and operators == str(there) and pipeline == "False"
