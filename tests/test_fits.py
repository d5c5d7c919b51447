"""Fits at the same time, search by densities, permutations, and a stop inside training."""

from __future__ import annotations

import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlake.models import regress, search
from spendlake.models.pool import together
from spendlake.models.regress import (
    Ridge, assemble, boosted, cross_validate, fit_stopped, fold_fits, forest, permutation_importance, stop_round,
)
from spendlake.operators import sampling, stats
from spendlake.operators.permutation import permuted
from spendlake.schema import UNKNOWN

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    made = np.random.default_rng(3)
    pdf = pd.DataFrame(made.normal(size=(500, 3)), columns=FEATURES)
    pdf["label"] = 2 * pdf["a"] + np.sin(2 * pdf["b"]) + made.normal(0, 0.3, 500)
    pdf["row_id"] = [f"r{i:04d}" for i in range(500)]
    df = sampling.with_fold(sampling.with_split(spark.createDataFrame(pdf), "row_id"), "row_id", 3)
    return assemble(df, FEATURES).select("row_id", "features", "label", "split", "fold").repartition(2, "row_id").cache()


def test_fits_run_at_the_same_time_and_keep_their_names(spark):
    met = threading.Barrier(3, timeout=60)
    seen = together(spark, {name: lambda name=name: (met.wait(), spark.range(name).count())[1] for name in (5, 3, 4)}, at_once=3)
    assert list(seen.items()) == [(5, 5), (3, 3), (4, 4)]


def test_an_error_of_a_fit_is_raised(spark):
    with pytest.raises(ZeroDivisionError):
        together(spark, {"good": lambda: 1, "bad": lambda: 1 // 0})


def test_scores_are_those_of_fits_one_after_the_other(planted):
    learners = {"ridge": Ridge(1.0), "forest": forest(3, 3), "boosted": boosted(3, 2, 0.3, subsample=0.8)}
    got = {(r["model"], r["fold"]): r["rmse"] for r in cross_validate(planted, learners, folds=3).collect()}
    for name, learner in learners.items():
        for i in range(3):
            model = learner.fit(planted.filter(F.col("fold") != i))
            want = stats.scores(model.transform(planted.filter(F.col("fold") == i)), "label", "prediction").first()["rmse"]
            assert got[name, i] == pytest.approx(want, abs=1e-12)
    assert list(fold_fits(planted, {"x": None}, folds=2)) == [("x", 0), ("x", 1)]


def test_fits_at_once_share_the_cores(spark, planted, monkeypatch):
    """Each of eight fits has two tasks for eight cores, more only for more rows; a boosted tree keeps no frame of nodes."""
    wide, tasks, real = planted.repartition(8).cache(), [], regress.GBTRegressor.fit

    def fit(learner, df):
        tasks.append((df.rdd.getNumPartitions(), learner.getCacheNodeIds()))
        return real(learner, df)

    monkeypatch.setattr(regress.GBTRegressor, "fit", fit)
    regress.Stack({"a": boosted(1, 2), "b": boosted(1, 1)}, folds=3).fit(wide)
    search.search(wide, trials=2, rounds=1, folds=3, per_round=2)
    each = regress.training_partitions(spark, 500, 8)
    assert each == -(-2 * spark.sparkContext.defaultParallelism // 8) and len(tasks) == 8 + 6
    assert tasks[:8] == [(each, False)] * 8 and {t for t in tasks[8:]} == {(regress.training_partitions(spark, 500, 6), False)}
    assert regress.training_partitions(spark, each * regress.TASK_ROWS + 1, 8) == 2 * each


@pytest.mark.parametrize("patience, first", [(2, 4), (6, 3)])
def test_stop_inside_training_gives_the_model_of_all_rounds_cut(planted, patience, first):
    train, held = planted.filter("split = 'train'"), planted.filter("split = 'validation'")
    learner = boosted(24, 4, 0.5, subsample=0.7)
    errors = learner.fit(train).evaluateEachIteration(held, "squared")
    best = stop_round(errors, patience)
    fitted = []
    copy = learner.copy
    learner.copy = lambda extra: fitted.append(list(extra.values())[0]) or copy(extra)
    model = fit_stopped(learner, train, held, patience, first)
    assert model.getNumTrees == best
    assert stats.scores(model.transform(held), "label", "prediction").first()["rmse"] ** 2 == pytest.approx(errors[best - 1])
    assert fitted[-1] <= max(first, 2 * (best + patience)) and fitted[-1] <= 24


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 100, 1000, 4097])
def test_permutation_is_one(spark, n):
    rows = spark.range(n).select(*[permuted(F.col("id"), n, seed).alias(f"s{seed}") for seed in (1, 2)]).toPandas()
    assert sorted(rows["s1"]) == sorted(rows["s2"]) == list(range(n))
    if n >= 1000:
        assert abs(np.corrcoef(np.arange(n), rows["s1"])[0, 1]) < 0.15 and (rows["s1"] == rows["s2"]).mean() < 0.02


def test_permutation_importance_with_one_join_for_all_repeats(planted):
    model = forest(10, 5).fit(planted)
    found = permutation_importance(planted, model, FEATURES, repeats=4)
    got = {r["feature"]: r["importance"] for r in found.collect()}
    assert got["a"] > got["b"] > abs(got["c"]) and set(got) == set(FEATURES)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") <= 2


def test_search_by_densities_finds_better_settings():
    """A smooth score over the ranges: later proposals lie nearer to its top than the first ten."""
    score = lambda s: -abs(s["depth"] - 8) / 6 - abs(s["rate"] - 0.1) * 3 - abs(s["columns"] - 0.9)
    better = 0
    for seed in range(8):
        made, seen = random.Random(seed), []
        for _ in range(40):
            setting = search.propose(seen, made)
            assert all(low <= setting[k] <= high for k, (low, high) in search.SEARCH.items()) and isinstance(setting["depth"], int)
            seen.append((setting, score(setting)))
        early, late = [s for _, s in seen[:10]], [s for _, s in seen[-10:]]
        better += sum(late) / 10 > sum(early) / 10
    assert better >= 7


def test_search_runs_all_folds_and_repeats_itself(planted):
    runs = [search.search(planted, trials=13, rounds=1, folds=3, per_round=2).orderBy("trial").collect() for _ in range(2)]
    assert runs[0] == runs[1] and [r["trial"] for r in runs[0]] == list(range(13))
    assert [r["proposed_in"] for r in runs[0]] == [0] * 10 + [1, 1, 2]


def test_short_dictionaries_cost_no_exchange_of_the_rows(spark, tmp_path):
    spark.range(20_000).selectExpr("string(id % 5) AS p", "string(id % 3) AS q", "id").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    coded = sampling.encode_labels(rows, ["p", "q"])
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in plan
    assert coded.where("p_enc <> int(p) OR q_enc <> int(q)").count() == 0


def test_a_long_dictionary_is_merged(spark):
    rows = spark.range(3000).selectExpr("format_string('%05d', id) AS p", "nullif(id % 2, 1) AS q")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        coded = sampling.encode_labels(rows, ["p", "q"])
        assert "SortMergeJoin" in coded._jdf.queryExecution().executedPlan().toString()
        assert coded.where("p_enc <> int(p)").count() == 0
        assert {(r["q"], r["q_enc"]) for r in coded.select("q", "q_enc").distinct().collect()} == {(0, 0), (None, 1)} and UNKNOWN > "0"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dictionaries_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "p string, q string")
    assert sampling.encode_labels(empty, ["p", "q"]).columns == ["p", "q", "p_enc", "q_enc"]
    assert sampling.encode_labels(empty, ["p", "q"]).count() == 0
