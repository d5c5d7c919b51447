"""Model operators find planted signal and agree with closed forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from spendlake.models import anomaly, cluster
from spendlake.models.regress import (
    KernelRegression, Ridge, Scaler, Stack, align_importances, assemble, best_model, boosted,
    compare, cross_validate, fold_summary, forest, importances, inverse_error_weights,
    permutation_importance, search_grid, training_partitions, tune,
)
from spendlake.operators import sampling, stats

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """y = 2a + sin(b) + noise; c is noise."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    pdf = pd.DataFrame(x, columns=FEATURES)
    pdf["label"] = 2 * pdf["a"] + np.sin(2 * pdf["b"]) + rng.normal(0, 0.05, 600)
    pdf["row_id"] = [f"r{i:04d}" for i in range(600)]
    df = sampling.with_fold(spark.createDataFrame(pdf), "row_id", 3)
    return pdf, assemble(df, FEATURES).cache()


def r2(model, df):
    return stats.scores(model.transform(df), "label", "prediction").first().r2


def test_ridge_equals_closed_form(planted):
    pdf, df = planted
    model = Ridge(5.0).fit(df)
    x, y = pdf[FEATURES].to_numpy(), pdf["label"].to_numpy()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients, want, atol=1e-8)


def test_scaler_uses_population_deviation(spark, planted):
    pdf, df = planted
    scaled = Scaler.fit(df, ["a"]).transform(df.select("a")).toPandas()["a"]
    assert abs(scaled.mean()) < 1e-9 and abs(scaled.std(ddof=0) - 1) < 1e-9
    flat = spark.createDataFrame([(2.0,), (2.0,)], "z double")
    assert Scaler.fit(flat, ["z"]).transform(flat).toPandas()["z"].tolist() == [0.0, 0.0]


def test_learners_find_the_signal(planted):
    _, df = planted
    tree = forest(10, 6).fit(df)
    assert r2(tree, df) > 0.8
    ranked = importances(tree, FEATURES, df).toPandas().set_index("feature")["importance"]
    assert ranked.idxmax() == "a" and ranked["c"] < ranked["b"]
    assert r2(boosted(15, 3, 0.3).fit(df), df) > 0.8
    assert r2(KernelRegression(FEATURES, 128).fit(df), df) > 0.95


def test_early_stopping_column(planted):
    _, df = planted
    marked = df.withColumn("hold", F.col("fold") == 0)
    assert boosted(10, 3, 0.3, validation="hold").fit(marked).getNumTrees <= 10


def test_cross_validation_weights_and_choice(planted):
    _, df = planted
    summary = fold_summary(cross_validate(df, {"ridge": Ridge(1.0), "forest": forest(5, 4)}, folds=3)).cache()
    assert summary.count() == 2 and summary.filter("mean_r2 > 0.5").count() == 2
    weights = inverse_error_weights(summary).toPandas()
    assert abs(weights["weight"].sum() - 1) < 1e-12
    best = best_model(summary).first()
    assert best.best_model == weights.sort_values("rmse").iloc[0]["model"]
    assert compare(summary, "mean_r2").filter("is_best = 1").count() == 1


def test_stack_and_search(planted):
    _, df = planted
    model = Stack({"ridge": Ridge(1.0), "tree": forest(5, 5)}, folds=3).fit(df)
    assert set(model.weights) == {"ridge", "tree"} and r2(model, df) > 0.8
    grid = search_grid(2, depth=(4, 4))
    assert grid == search_grid(2, depth=(4, 4))
    fitted, table = tune(df, grid, rounds=3, folds=3)
    assert table.count() == 2 and fitted.bestModel is not None


def test_permutation_importance(planted):
    _, df = planted
    model = Ridge(1.0).fit(df)
    out = permutation_importance(df, model, FEATURES, repeats=2).toPandas().set_index("feature")["importance"]
    assert out.idxmax() == "a" and out["a"] > 0.5 and abs(out["c"]) < 0.01


def test_importance_alignment(spark):
    a = spark.createDataFrame([("x", 1.0)], "feature string, importance double")
    b = spark.createDataFrame([("y", 2.0)], "feature string, importance double")
    got = {r.feature: (r.m, r.n) for r in align_importances({"m": a, "n": b}).collect()}
    assert got == {"x": (1.0, 0.0), "y": (0.0, 2.0)}


def test_isolation_forest_flags_the_outliers(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(1000, 2)), columns=["x", "y"])
    pdf.loc[:9, ["x", "y"]] = rng.uniform(8, 12, (10, 2))
    pdf["row_id"] = [f"r{i}" for i in range(1000)]
    df = spark.createDataFrame(pdf)
    nodes = anomaly.fit_trees(df, ["x", "y"], trees=25).cache()
    assert nodes.groupBy("tree").count().filter("count > 511").count() == 0
    flagged = anomaly.flag(anomaly.score(df, nodes, ["x", "y"]).cache(), 0.02).toPandas()
    assert flagged["is_anomaly"].sum() == 20
    assert flagged.set_index("row_id").loc[[f"r{i}" for i in range(10)], "is_anomaly"].all()


def test_clusters_separate(spark):
    rng = np.random.default_rng(9)
    rows = [(f"c{i}", float(np.exp(rng.normal(3 + 6 * (i % 2), 0.1))), 10.0 + 500 * (i % 2), 20 + 80 * (i % 2), 3, 3)
            for i in range(60)]
    profile = spark.createDataFrame(rows, "customer_id string, total_spend double, avg_spend double, "
                                          "transactions long, unique_categories long, unique_distributors long")
    df = cluster.cluster_frame(profile).cache()
    out = cluster.assign(df, cluster.fit_kmeans(df, 2))
    sizes = cluster.cluster_profile(out, ["total_spend"]).toPandas()
    assert sizes["size"].tolist() == [30, 30]
    inertia = cluster.elbow(df, range(2, 4), (1,)).toPandas()["inertia"].tolist()
    assert inertia[0] >= inertia[1] >= 0
    assert cluster.assign(df, cluster.fit_bisecting(df, 2)).select("cluster").distinct().count() == 2


def test_standardised_regression_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(40, 2)) * [3, 10] + [1, 5], columns=["p", "q"])
    pdf["total_spend"] = 4 * pdf["p"] - pdf["q"] + rng.normal(size=40)
    got = {r.factor: r.coefficient for r in stats.standardised_regression(spark.createDataFrame(pdf), ["p", "q"]).collect()}
    z = (pdf[["p", "q"]] - pdf[["p", "q"]].mean()) / (pdf[["p", "q"]].std(ddof=0) + 1e-9)
    want = np.linalg.lstsq(np.column_stack([np.ones(40), z]), pdf["total_spend"], rcond=None)[0]
    assert np.allclose([got["intercept"], got["p"], got["q"]], want)


def _profiles(spark, rows):
    return spark.range(rows).selectExpr("CAST(id AS STRING) AS customer_id", "CAST(exp(id % 9) AS DOUBLE) AS total_spend",
                                        "CAST(id % 9 + 1 AS DOUBLE) AS avg_spend", "id % 7 AS transactions",
                                        "id % 5 AS unique_categories", "id % 3 AS unique_distributors")


def test_cluster_frame_is_dealt_and_its_profile_made_once(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TASK_ROWS", 100)
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: made.add(1) or v, "string").asNondeterministic()
    frame = cluster.cluster_frame(_profiles(spark, 1000).coalesce(1).withColumn("customer_id", seen("customer_id")))
    assert frame.rdd.getNumPartitions() == 10 and frame.count() == 1000 and made.value == 1000


def test_restarts_at_the_same_time_give_the_best_of_each(spark):
    df = cluster.cluster_frame(_profiles(spark, 300)).cache()
    both = cluster.best_fits(df, [2, 3], (1, 2))
    for k, model in both.items():
        alone = [KMeans(k=k, seed=s).fit(df).summary.trainingCost for s in (1, 2)]
        assert model.summary.trainingCost == pytest.approx(min(alone))


def test_steps_of_all_rows_reach_the_leaves_of_each_tree():
    made = np.random.default_rng(3)
    x = np.column_stack([made.integers(0, n, 500).astype(float) for n in (2, 30, 400)])
    trees = [pd.DataFrame(anomaly._grow(x[made.integers(0, 500, n)], made), columns=["node", "feature", "cut", "left", "depth"])
             .sort_values("node").assign(rows=n) for n in (1, 2, 50, 256)]

    def reached(row, tree):
        nodes, at = tree.set_index("node"), 0
        while nodes.at[at, "feature"] >= 0:
            at = nodes.at[at, "left"] + int(row[nodes.at[at, "feature"]] > nodes.at[at, "cut"])
        return nodes.at[at, "depth"] / anomaly._average_path(max(2, tree["rows"].iloc[0]))

    want = [sum(reached(row, tree) for tree in trees) for row in x]
    assert anomaly._depths(x, [anomaly._pack(tree) for tree in trees]) == pytest.approx(want, abs=1e-12)


def test_training_tasks_follow_cores_and_rows(spark):
    """Not the shuffle's partitions: every task of a pass sends the statistics of all its nodes."""
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        assert [training_partitions(spark, n) for n in (0, 10, cores * 1_000_000, cores * 1_000_000 + 1)] == [cores, cores, cores, 2 * cores]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
