"""The stages in a row: each works on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from threadmill.llm.common import scratch_path


def test_stages_in_a_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids, name
        assert kept, name
        if name != "tokens":
            assert docs.columns == columns, name
        if name in ("quality", "near_duplicates", "decontamination"):
            assert docs.count() <= before, name
        ids = kept
    assert docs.count() == before
    at = 0
    for row in docs.orderBy("start").collect():
        assert row.start == at and row.n_tokens >= 1
        at += row.n_tokens
