"""The pipeline's stages one after another, and on odd tables."""

from __future__ import annotations

import re

import corpus_pipeline
from conftest import SF
from tallyframe.llm import queries
from tallyframe.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, corpus):
    docs = corpus
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, SF), "test-stage")
        assert docs.count() <= before.count()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == COLUMNS
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) > 100
    assert sorted(ids) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())


def test_stages_on_odd_tables(spark, odd, nothing):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()


def test_registered():
    for n in range(1, 11):
        assert sum(re.match(rf"op{n}_", q) is not None for q in queries.QUERIES) == 1
    assert "pipeline" in queries.QUERIES
