"""Distributed order operators equal one global window, at any partitioning and under skew."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlake.operators import ranking, sampling


@pytest.fixture(params=[1, 8])
def slices(spark, request):
    """One slice, and eight that adaptive execution must not merge."""
    settings = {"spark.sql.shuffle.partitions": str(request.param),
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


def skewed(spark, n=3000):
    """A third of the rows in one group, a third of the values equal."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({
        "k": [f"{i:05d}" for i in range(n)],
        "g": ["hot" if i % 3 == 0 else f"g{i % 20}" for i in range(n)],
        "v": [0.0 if i % 3 == 1 else float(x) for i, x in enumerate(rng.integers(0, 500, n))]})
    return pdf, spark.createDataFrame(pdf)


def test_position_and_running_sum(spark, slices):
    pdf, df = skewed(spark)
    got = ranking.with_position(df, [F.desc("v"), "k"], "p", {"c": "v"}).toPandas().sort_values("p")
    want = pdf.sort_values(["v", "k"], ascending=[False, True])
    assert got["k"].tolist() == want["k"].tolist()
    assert got["p"].tolist() == list(range(1, len(pdf) + 1))
    assert got["c"].tolist() == want["v"].cumsum().tolist()


def test_eight_slices_are_used(spark, slices):
    _, df = skewed(spark)
    parts = df.repartitionByRange("v", "k").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == slices


def test_group_position(spark, slices):
    pdf, df = skewed(spark)
    got = ranking.with_group_position(df, ["g"], ["v", "k"], "p").toPandas().set_index("k")["p"]
    want = pdf.sort_values(["v", "k"]).groupby("g").cumcount() + 1
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_quantiles(spark, slices):
    pdf, df = skewed(spark)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.98, "e": 1.0}
    got = ranking.quantiles(df, ["g"], "v", probs).toPandas().set_index("g").sort_index()
    for name, p in probs.items():
        want = pdf.groupby("g")["v"].quantile(p).sort_index()
        assert np.allclose(got[name], want)
    whole = ranking.quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == pdf["v"].median()


def test_gini_against_the_formula(spark, slices):
    pdf, df = skewed(spark)
    v = np.sort(pdf["v"].to_numpy())
    n = len(v)
    want = 2 * np.sum(np.arange(1, n + 1) * v) / (n * v.sum()) - (n + 1) / n
    assert abs(ranking.gini(df, "k", "v").first().gini - want) < 1e-9


def test_sample_is_exact_per_stratum_and_stable(spark, slices):
    pdf, df = skewed(spark)
    got = sampling.stratified_sample(df, "g", "k", 300).toPandas()
    assert len(got) <= 300 and got["k"].is_unique
    counts, sizes = got["g"].value_counts(), pdf["g"].value_counts()
    for g, n in sizes.items():
        assert abs(counts.get(g, 0) - round(300 / len(pdf) * n)) <= 1
    again = sampling.stratified_sample(df.repartition(5), "g", "k", 300).toPandas()
    assert sorted(got["k"]) == sorted(again["k"])
    assert sampling.stratified_sample(df, "g", "k", 10_000).count() == len(pdf)


def test_codes_are_alphabetical(spark, slices):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "x"), ("a", "y")], "p string, q string")
    coded = sampling.encode_labels(df, ["p", "q"]).toPandas()
    assert dict(zip(coded["p"], coded["p_enc"])) == {"a": 0, "b": 1, "c": 2}
    assert set(coded.loc[coded["q"].isna(), "q_enc"]) == {0}


def test_split_shares(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    shares = {r.split: r["count"] / 20_000 for r in sampling.with_split(df, "k").groupBy("split").count().collect()}
    assert abs(shares["test"] - 0.2) < 0.01 and abs(shares["validation"] - 0.16) < 0.01


def test_block_folds_keep_keys_together(spark):
    df = spark.createDataFrame([(f"s{i:02d}", j) for i in range(10) for j in range(3)], "state string, j int")
    folds = {r.state: r.fold for r in sampling.with_block_fold(df, "state").collect()}
    assert [folds[f"s{i:02d}"] for i in range(10)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_mean_and_consensus_rank(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0), ("b", 3.0, None), ("c", 1.0, 2.0)], "f string, m1 double, m2 double")
    got = {r.f: r.avg_rank for r in ranking.mean_rank(df, "f", ["m1", "m2"]).collect()}
    assert got == {"a": 1.75, "b": 1.5, "c": 2.0}
    long = spark.createDataFrame([("m1", "a", 9.0), ("m1", "b", 1.0), ("m2", "b", 5.0)], "m string, f string, v double")
    ranks = {r.f: r.avg_rank for r in ranking.consensus_rank(long, "f", "m", "v").collect()}
    assert ranks == {"b": 1.5, "a": 8.0}


def test_top_lists(spark):
    df = spark.createDataFrame([(f"k{i:02d}", float(i)) for i in range(20)], "k string, spend double")
    other = {r.k: r.spend for r in ranking.top_with_other(df, 12, "k").collect()}
    assert len(other) == 13 and other["Other"] == sum(range(8))
    both = ranking.top_and_bottom(df, 2, "spend", "k").collect()
    assert {(r.side, r["rank"], r.k) for r in both} == {
        ("top", 1, "k19"), ("top", 2, "k18"), ("bottom", 1, "k00"), ("bottom", 2, "k01")}


def test_few_groups_are_not_shuffled_to_a_task_each(spark, monkeypatch):
    """The brackets' size is known, so Spark broadcasts them; a merge join would sort a whole group in one task."""
    plans, place = [], ranking.with_position
    monkeypatch.setattr(ranking, "with_position", lambda df, *a, **k: plans.append(
        df._jdf.queryExecution().sparkPlan().toString()) or place(df, *a, **k))
    df = spark.range(1000).selectExpr("id % 2 AS g", "id AS v").repartition(4)
    got = {r["g"]: r["m"] for r in ranking.quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {0: 499.0, 1: 500.0}
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
