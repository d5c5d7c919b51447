"""The stages of the pipeline, one after the other, on messy rows and on a given table."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from spendlake.llm.shared import written


@pytest.fixture(scope="module")
def stages(spark, messy, folder):
    docs, out = messy.select(corpus_pipeline.COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, folder), name)
        out[name] = before, docs
    return out


def test_columns(stages):
    for name, (_, after) in stages.items():
        assert name == "bpe" or after.columns == corpus_pipeline.COLUMNS


def test_rejected_documents_have_no_language(stages):
    before, after = stages["language_id"]
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert {100, 101, 102, 103, 122} <= gone and not gone & set(range(0, 100))


def test_repeated_passage_stays_once(stages):
    before, after = stages["line_dedup"]
    has = lambda df: {r["doc_id"] for r in df.where("contains(text, 'shared line two')").collect()}
    assert len(has(before)) == 6 and has(after) == {110}


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    ids = {r["doc_id"] for r in after.collect()}
    assert len(ids & set(range(30, 90))) == 1 and set(range(30)) <= ids


def test_mix_repeats_documents(stages):
    before, after = stages["mix_sources"]
    known = {(r["doc_id"], r["text"]) for r in before.collect()}
    got = Counter((r["doc_id"], r["text"]) for r in after.collect())
    assert set(got) <= known and max(got.values()) <= 2 * 3


def test_tokens_of_every_row(stages):
    before, after = stages["bpe"]
    assert after.count() == before.count() and {"n_tokens", "ids", "ids_sha256"} <= set(after.columns)


def test_run_and_empty_table(spark, folder, empty):
    assert corpus_pipeline.run(spark, folder).count() > 0
    docs = empty.select(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
    assert docs.count() == 0
