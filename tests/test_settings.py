"""Model queries run the settings of the reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlake.catalog import learning
from spendlake.models import regress
from spendlake.models.regress import PURCHASE_FEATURES, Ridge, assemble, boosted, stop_round, stopped
from spendlake.operators import sampling, stats


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(400, len(PURCHASE_FEATURES))), columns=PURCHASE_FEATURES)
    pdf["label"] = 2 * pdf.iloc[:, 0] + rng.normal(0, 0.5, 400)
    pdf["row_id"] = [f"r{i}" for i in range(400)]
    df = sampling.with_fold(sampling.with_split(spark.createDataFrame(pdf), "row_id"), "row_id")
    return assemble(df, PURCHASE_FEATURES).select("row_id", "features", "label", "split", "fold").cache()


@pytest.fixture
def asked(lines, monkeypatch):
    """What the queries ask for; small models are fitted in place of it."""
    calls = []

    def forest(trees=200, depth=12, min_rows=1):
        calls.append(("forest", trees, depth, min_rows))
        return regress.forest(2, 2)

    def boosted(rounds=300, depth=5, rate=0.05, subsample=1.0, columns=1.0, min_rows=1, validation=None):
        assert validation is None
        calls.append(("boosted", rounds, depth, rate, subsample, columns, min_rows))
        return regress.boosted(1, 2)

    monkeypatch.setattr(learning, "forest", forest)
    monkeypatch.setattr(learning, "boosted", boosted)
    monkeypatch.setattr(learning, "_lines", lambda spark, folder: lines)
    return calls


def test_forest_and_boosted_trees(spark, asked):
    learning.random_forest(spark, "")
    learning.boosted_trees(spark, "")
    assert asked == [("forest", 200, 12, 1), ("boosted", 300, 7, 0.05, 0.9, 0.9, 1)]


def test_stack_has_all_rounds_and_folds(spark, asked, monkeypatch):
    class Recorded(regress.Stack):
        def fit(self, df):
            asked.append(("folds", self.folds, {r[0] for r in df.select("fold").distinct().collect()}))
            return Ridge(1.0).fit(df)

    monkeypatch.setattr(learning, "Stack", Recorded)
    learning.stacking(spark, "")
    assert asked == [("boosted", 100, 6, 0.05, 1.0, 1.0, 1), ("boosted", 100, 6, 0.05, 1.0, 1.0, 20),
                     ("forest", 100, 10, 1), ("boosted", 100, 5, 0.05, 1.0, 1.0, 1), ("folds", 5, {0, 1, 2, 3, 4})]


def test_search_has_all_trials_and_a_refit(spark, asked, monkeypatch):
    def search(df, trials, rounds, folds):
        asked.append((trials, rounds, folds, {r[0] for r in df.select("fold").distinct().collect()}))
        rows = [(i, i // 5, 4.0 + i % 7, 0.1, 0.8, 0.7, 0.9 if i == 7 else 0.1) for i in range(trials)]
        return spark.createDataFrame(
            rows, "trial int, proposed_in int, depth double, rate double, subsample double, columns double, mean_r2 double")

    monkeypatch.setattr(learning, "search_settings", search)
    monkeypatch.setattr(regress, "boosted", lambda rounds, *rest: asked.append((rounds, *rest)) or boosted(1, 2))
    got = learning.search(spark, "").orderBy("trial").collect()
    assert asked == [(30, 100, 3, {0, 1, 2}), (200, 4, 0.1, 0.8, 0.7)]
    assert [r.trial for r in got if r.is_best] == [7] and len(got) == 30
    assert [r.trial for r in got if r.refit_r2 is not None and r.refit_rmse > 0] == [7]


def test_permutation_has_all_repeats(spark, asked, lines, monkeypatch):
    def importance(df, model, features, repeats):
        asked.append(repeats)
        return spark.createDataFrame([("x", 0.5)], "feature string, importance double")

    monkeypatch.setattr(learning, "permutation_importance", importance)
    learning.permutation(spark, "")
    assert asked == [("boosted", 200, 8, 0.1, 1.0, 1.0, 20), 10]


def test_comparison_has_all_models(spark, asked, monkeypatch):
    monkeypatch.setattr(learning, "_stack", lambda df: Ridge(2.0).fit(df))
    monkeypatch.setattr(learning, "_search", lambda df: ((0, Ridge(3.0).fit(df)), None))
    names = {r.model for r in learning.comparison(spark, "").collect()}
    assert names == {"random_forest", "histogram_boosted", "boosted", "boosted_leaves", "stacking", "boosted_tuned", "ridge"}
    assert asked == [("forest", 200, 12, 1), ("boosted", 200, 8, 0.1, 1.0, 1.0, 20),
                     ("boosted", 300, 7, 0.05, 0.9, 0.9, 1), ("boosted", 300, 7, 0.05, 0.9, 0.9, 20)]


def test_panel_learners_and_folds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(learning, "_panel", lambda *a: None)
    monkeypatch.setattr(learning, "cross_validate", lambda df, learners, folds=5: seen.append((learners, folds)))
    monkeypatch.setattr(learning, "fold_summary", lambda df: None)
    learning.cross_validation(spark, "")
    monkeypatch.setattr(learning, "state_panel", lambda *a: None)
    monkeypatch.setattr(learning, "settle", lambda df: None)
    for name in ("state_reference", "event_calendar", "event_uplift"):
        monkeypatch.setattr(learning.star, name, lambda *a: None)
    monkeypatch.setattr(learning.outlook, "run", lambda *a, learners=None, folds=5: seen.append(
        (learners or learning.fc.state_learners(), folds)))
    learning._outlook(spark, "")
    for learners, folds in seen:
        assert set(learners) == {"gradient_boosting", "random_forest", "ridge", "kernel"} and folds == 5
        assert learners["gradient_boosting"].getMaxIter() == 300
        assert (learners["random_forest"].getNumTrees(), learners["random_forest"].getMaxDepth()) == (300, 8)
    assert len(seen) == 2


def test_stop_keeps_the_best_rounds(lines, monkeypatch):
    assert stop_round([3.0, 2.0, 2.5, 2.4, 1.0], 2) == 2 and stop_round([3.0, 2.0, 2.5, 2.4, 1.0], 3) == 5
    assert stop_round([float("nan")] * 4, 2) == 4
    model = boosted(5, 3, 0.3).fit(lines)
    errors = model.evaluateEachIteration(lines, "squared")
    monkeypatch.setattr(regress, "stop_round", lambda *a: 3)
    cut = stopped(model, lines, 20)
    rmse = stats.scores(cut.transform(lines), "label", "prediction").select(F.col("rmse")).first()[0]
    assert cut.getNumTrees == 3 and abs(rmse ** 2 - errors[2]) < 1e-9 and len(cut.featureImportances) == len(PURCHASE_FEATURES)


def test_outlook_is_fitted_once_for_all_that_read_it(spark, folder, monkeypatch):
    made, marks = [], iter(["a", "a", "b"])
    frame = spark.createDataFrame([("S", 200101, 2.0)], "state string, year_month int, spend double")
    monkeypatch.setattr(learning, "_outlook", lambda *a: made.append(1) or (frame, None))
    monkeypatch.setattr(learning, "_OUTLOOKS", {})
    monkeypatch.setattr(learning.files, "file_fingerprint", lambda *a: next(marks))
    assert [learning._outlook_table(spark, folder).count() for _ in range(3)] == [1, 1, 1] and len(made) == 2


def test_file_fingerprint_follows_the_files(spark, tmp_path):
    from spendlake.sources.files import file_fingerprint

    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/t")
    first = file_fingerprint(spark, f"{tmp_path}/t")
    assert first == file_fingerprint(spark, f"{tmp_path}/t")
    spark.range(6).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    assert first != file_fingerprint(spark, f"{tmp_path}/t")
