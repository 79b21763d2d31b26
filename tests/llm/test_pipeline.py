"""The pipeline's stages on a small corpus with planted cases, against brute force."""

import re

import corpus_pipeline
from reviewspark.llm.common import stored
from reviewspark.llm.pieces import PieceModel

from test_dedup import plain_fingerprint, plain_lines, roots


def test_stages_over_the_smallest_tables(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = [r.text.lower() for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, tiny), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert set(after) == {i for i, t in before.items() if any(map(str.isalpha, t))}
        elif name == "line_dedup":
            order = sorted(before)
            left = dict(zip(order, plain_lines([(i, before[i]) for i in order])))
            assert after == {i: t for i, t in left.items() if t or not before[i]}
        elif name == "near_dedup":
            fp = {i: plain_fingerprint(t) for i, t in before.items()}
            root = roots(before, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
            assert set(after) == set(root.values())
        else:
            held = {i for i, t in before.items() if any(item in t.lower() for item in items)}
            assert held and held <= set(before) - set(after)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    model = PieceModel.load()
    assert {r.doc_id: model.decode(r.ids) for r in last} == before
    whole = corpus_pipeline.run(spark, tiny).select("doc_id", "ids").collect()
    assert {r.doc_id: r.ids for r in whole} == {r.doc_id: r.ids for r in last}


def test_stages_take_odd_rows(spark, odd, tiny):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, tiny), f"odd-{name}")
        assert docs.count() > 0
    empty = odd.select("doc_id", "text", "lang", "source", "n_chars").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, tiny), f"none-{name}")
        assert empty.count() == 0


def test_stages_pass_other_columns_through(spark, odd, tiny):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, tiny), f"clash-{name}")
        assert after.columns == odd.columns and after.dtypes == odd.dtypes
        # What is left of a row keeps its other columns.
        others = [c for c in odd.columns if c not in ("text", "n_chars")]
        left = {tuple(r) for r in after.select(*others).collect()}
        assert left and left <= {tuple(r) for r in odd.select(*others).collect()}
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert {"ids", "ids_", "n_tokens", "n_tokens_", "lang", "n_lines"} <= set(last.columns) and last.count() == docs.count()
    few = odd.select("doc_id", "text", "lang")
    for name, stage in corpus_pipeline.STAGES:
        few = stored(stage(spark, few, tiny), f"few-{name}")
        assert few.count() > 0
