"""Clustering features: totals, bounds, merging, and planted groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spendlake.models.features_tree import Features, cluster_by_features, gather, joined


def planted(groups=5, each=200, seed=2):
    made = np.random.default_rng(seed)
    centres = made.uniform(-20, 20, (groups, 3))
    return np.concatenate([c + made.normal(0, 0.5, (each, 3)) for c in centres]), np.repeat(np.arange(groups), each)


@pytest.mark.parametrize("entries, parts", [(400, 1), (30, 3), (12, 20)])
def test_totals_are_those_of_the_rows(spark, entries, parts):
    x, _ = planted()
    frame = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(parts)
    found = gather(frame, entries)
    assert len(found.n) <= entries and found.n.sum() == len(x)
    assert np.allclose(found.total.sum(axis=0), x.sum(axis=0)) and np.isclose(found.square.sum(), (x ** 2).sum())
    spread = found.square / found.n - ((found.total / found.n[:, None]) ** 2).sum(axis=1)
    assert (spread <= found.threshold ** 2 + 1e-9).all()


def test_planted_groups_are_found(spark):
    x, group = planted(7, 150)
    rows = [(i, row.tolist(), int(g)) for i, (row, g) in enumerate(zip(x, group))]
    frame = spark.createDataFrame(rows, "id long, v array<double>, planted int").repartition(5)
    got = cluster_by_features(frame.withColumn("features", array_to_vector("v")), 7, entries=60)
    table = got.groupBy("planted", "cluster").count().collect()
    assert len(table) == 7 and {r["count"] for r in table} == {150} and {r["cluster"] for r in table} == set(range(7))


def test_joining_takes_the_least_growth():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [5.3], [9.0]])
    groups = joined(Features.of_rows(x), 3)
    assert groups[0] == groups[1] and groups[2] == groups[3] == groups[4] and len(set(groups)) == 3


def test_few_equal_and_no_rows(spark):
    vector = lambda df: df.withColumn("features", array_to_vector("v"))
    same = spark.createDataFrame([([1.0, 2.0],)] * 50, "v array<double>").repartition(4)
    assert [tuple(r) for r in cluster_by_features(vector(same), 7).groupBy("cluster").count().collect()] == [(0, 50)]
    assert cluster_by_features(vector(same.filter("false")), 7).count() == 0
    assert gather(same.filter("false").select(F.col("v").alias("x"))) is None
