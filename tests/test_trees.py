"""Fits that a task holds: the trees of Spark's learners, in a few jobs."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import regression as spark_ml

from spendlake.catalog import learning
from spendlake.models import trees
from spendlake.models.regress import assemble, boosted, cut, forest, permutation_importance
from spendlake.models.swapped import Walks
from spendlake.operators import stats
from spendlake.operators.clean import positive_spend
from spendlake.session import shared_dir
from spendlake.sources import star

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def planted(spark):
    """``a`` is continuous, ``b`` and ``c`` have few and many values, ``d`` is constant."""
    made = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": made.normal(size=900), "b": made.integers(0, 3, 900) * 1.0, "c": made.integers(0, 60, 900) * 1.0, "d": 1.0})
    pdf["label"] = 2 * pdf["a"] + np.sin(pdf["b"]) + 0.01 * pdf["c"] ** 2 * (pdf["b"] == 1) + made.normal(0, 0.3, 900)
    return assemble(spark.createDataFrame(pdf), FEATURES).select("features", "label").repartition(3).cache()


def predicted(model, df):
    return np.array([r[0] for r in model.transform(df).select("prediction").collect()])


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("rounds, depth, least", [(5, 5, 5), (3, 8, 1)])
def test_boosted_trees_are_those_of_spark_in_a_few_jobs(spark, planted, rounds, depth, least):
    mine, count = jobs(spark, f"boosted {depth}", lambda: boosted(rounds, depth, 0.2, min_rows=least).fit(planted))
    learner = spark_ml.GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=0.2, minInstancesPerNode=least, seed=42)
    theirs, before = jobs(spark, f"spark {depth}", lambda: learner.fit(planted))
    assert isinstance(mine, spark_ml.GBTRegressionModel) and count <= 16 < before
    assert predicted(mine, planted) == pytest.approx(predicted(theirs, planted), abs=1e-9)
    # In nodes of a few rows splits of two features tie, so the gains may go to either.
    assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-9 if least > 1 else 1e-3)
    assert mine.treeWeights == theirs.treeWeights and cut(mine, 2).getNumTrees == 2


def test_a_forest_draws_by_the_law_of_spark_in_a_few_jobs(spark, planted):
    mine, count = jobs(spark, "forest", lambda: forest(60, 7).fit(planted))
    theirs = spark_ml.RandomForestRegressor(numTrees=60, maxDepth=7, featureSubsetStrategy="all", seed=42).fit(planted)
    assert isinstance(mine, spark_ml.RandomForestRegressionModel) and mine.getNumTrees == 60 and count <= 16
    assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.1)
    assert mine.totalNumNodes == pytest.approx(theirs.totalNumNodes, rel=0.03)
    r2 = [stats.scores(m.transform(planted), "label", "prediction").first()["r2"] for m in (mine, theirs)]
    assert r2[0] == pytest.approx(r2[1], abs=0.01)
    assert (predicted(mine, planted) == predicted(forest(60, 7).fit(planted), planted)).all()


def test_rows_and_features_are_drawn(planted):
    whole, fewer = (boosted(8, 4, 0.2, subsample=s, columns=c).fit(planted) for s, c in ((1.0, 1.0), (0.6, 0.7)))
    assert abs(predicted(whole, planted) - predicted(fewer, planted)).max() > 0.01
    assert stats.scores(fewer.transform(planted), "label", "prediction").first()["r2"] > 0.7


def test_a_forest_of_more_rows_than_a_task_holds_is_left_to_spark(planted, monkeypatch):
    monkeypatch.setattr(trees, "TASK_FIT_ROWS", 100)
    monkeypatch.setattr(trees, "_pack", lambda *a: pytest.fail("one task"))
    assert forest(2, 3).fit(planted).getNumTrees == 2


def test_boosted_trees_over_blocks_are_those_of_one_task(spark, planted, monkeypatch):
    """Blocks of two rounds at most stay while a fit runs, and none after it."""
    whole, held, kept, folder = boosted(5, 5, 0.2, min_rows=3).fit(planted), [], trees._kept, Path(shared_dir(spark))
    before = len([*folder.glob("blocks-*")])
    monkeypatch.setattr(trees, "TASK_FIT_ROWS", 100)
    monkeypatch.setattr(trees, "_kept", lambda blocks: (kept(blocks), held.append(len([*folder.glob("blocks-*")]) - before))[0])
    found = boosted(5, 5, 0.2, min_rows=3).fit(planted)
    assert predicted(found, planted) == pytest.approx(predicted(whole, planted), abs=1e-9)
    assert found.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray(), abs=1e-9)
    assert held == [1, 2, 2, 2, 2] and len([*folder.glob("blocks-*")]) == before
    drawn = boosted(8, 4, 0.2, subsample=0.6, columns=0.7).fit(planted)
    assert stats.scores(drawn.transform(planted), "label", "prediction").first()["r2"] > 0.7


def test_thresholds_lie_between_values():
    assert trees.thresholds(np.array([1.0, 1.0, 2.0, 4.0]), 32).tolist() == [1.5, 3.0]
    assert trees.thresholds(np.ones(5), 32).tolist() == []
    many = trees.thresholds(np.arange(1000.0), 32)
    assert len(many) == 31 and np.diff(many).min() > 28 and np.diff(many).max() < 35


def test_cells_hold_all_digits():
    made = np.random.default_rng(1)
    bins = [5, 32, 2, 1, 7, 20]
    digits = np.stack([made.integers(0, b, 300) for b in bins]).astype(np.uint8)
    rows = trees.Binned.of(digits, bins, 100)
    for f, b in enumerate(bins):
        assert (rows.codes[rows.group[f]] // rows.unit[f] % b == digits[f]).all()
    assert max(rows.cells) <= 100 and len(rows.cells) < len(bins)


@pytest.mark.parametrize("fitted", [lambda df: boosted(6, 5, 0.3).fit(df), lambda df: forest(5, 7).fit(df),
                                    lambda df: spark_ml.GBTRegressor(maxIter=4, maxDepth=4, seed=1).fit(df)])
def test_one_walk_a_tree_gives_the_predictions_with_every_feature_swapped(spark, planted, fitted):
    model = fitted(planted)
    walks, x = Walks.of(model, len(FEATURES)), np.array([r[0].toArray() for r in planted.select("features").collect()])
    donor = np.random.default_rng(7).permutation(x)
    base, change = walks.predict(walks.digits(x), walks.digits(donor))
    assert base == pytest.approx(predicted(model, planted), abs=1e-9)
    for f in range(len(FEATURES)):
        mixed = x.copy()
        mixed[:, f] = donor[:, f]
        want = predicted(model, assemble(spark.createDataFrame(pd.DataFrame(mixed, columns=FEATURES)), FEATURES))
        assert base + change[f] == pytest.approx(want, abs=1e-9)


def test_importance_scores_no_row_a_feature(spark, planted):
    """A row a repeat is scored; features were rows of their own before. The losses are those of any other model's way."""
    df = planted.selectExpr("uuid() AS row_id", "features", "label").localCheckpoint()
    model = boosted(5, 4, 0.3).fit(df)

    class Other:
        transform = staticmethod(model.transform)

    found, want = (permutation_importance(df, m, FEATURES, repeats=3) for m in (model, Other()))
    assert [d._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") for d in (found, want)] == [1, 2]
    want = {r["feature"]: r["importance"] for r in want.collect()}
    assert {r["feature"]: r["importance"] for r in found.collect()} == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("task_rows", [1_000_000, 10])
def test_the_training_frame_replaces_the_lines_it_was_made_from(spark, folder, monkeypatch, task_rows):
    """Only the frame stays on the disks, as Parquet; many lines are not dealt out anew."""
    monkeypatch.setattr(learning, "TASK_ROWS", task_rows)
    kept = lambda: {p.name for p in Path(shared_dir(spark)).iterdir() if p.name.startswith(("lines-", "frame-")) and [*p.glob("*.parquet")]}
    before = kept()
    frame = learning._lines(spark, folder)
    assert [name.split("-")[0] for name in kept() - before] == ["frame"] and all("/frame-" in f for f in frame.inputFiles())
    want = positive_spend(star.spend_fact(spark, folder, "row_id", "spend"))
    assert frame.count() == want.count() and frame.join(want, "row_id", "left_anti").count() == 0
    assert frame.columns == ["row_id", "features", "label", "split", "fold"]
