"""The language stage's cut follows the number of learned languages."""

from __future__ import annotations

import corpus_pipeline
import pytest
from spendlake.llm import language_id


@pytest.mark.parametrize("languages,kept", [(1, {1, 2, 3, 4}), (2, {4}), (4, {3, 4}), (40, {2, 3, 4})])
def test_cut_is_a_multiple_of_chance(spark, monkeypatch, languages, kept):
    docs = spark.createDataFrame([(i, "text", "x", "s", 4) for i in range(1, 5)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    scored = docs.selectExpr("*", "'x' AS lang_pred", "element_at(array(0.02D, 0.05D, 0.55D, 0.65D), int(doc_id)) AS score")
    monkeypatch.setattr(language_id, "learn", lambda docs: ([str(i) for i in range(languages)], None))
    monkeypatch.setattr(language_id, "identify", lambda docs, known=None: scored)
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == kept
