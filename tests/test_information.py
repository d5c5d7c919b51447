"""Nearest-neighbour mutual information against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendlake.functions import digamma
from spendlake.operators import information
from spendlake.operators.information import knn_mutual_information, nearest_distance


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute(rows, column, k):
    kept = [(x[column], round(y / 1e-3)) for *x, y in rows if y is not None]
    sizes = Counter(x for x, _ in kept)
    kept = [r for r in kept if sizes[r[0]] > 1]
    if not kept:
        return 0.0
    total = 0.0
    for i, (x, y) in enumerate(kept):
        near = sorted(abs(y - b) for j, (a, b) in enumerate(kept) if a == x and j != i)
        kk = min(k, sizes[x] - 1)
        radius = near[kk - 1]
        m = sum(abs(y - b) < radius if radius else y == b for _, b in kept)
        total += psi(kk) - psi(sizes[x]) - psi(m)
    return max(0.0, psi(len(kept)) + total / len(kept))


@pytest.mark.parametrize("k, slice_rows", [(5, 10_000), (5, 7), (3, 11), (1, 2)])
def test_equals_plain_python(spark, k, slice_rows):
    made = random.Random(k * slice_rows)
    rows = []
    for i in range(260):
        a = made.choice(["hot", "hot", "b", None, f"v{made.randrange(60)}"])
        b = made.randrange(3)
        rows.append((a, b, i, made.choice([None, 2.5, 2.5 + b, round(made.gauss(b, 1), 3), round(made.random(), 1)])))
    frame = spark.createDataFrame(rows, "a string, b int, c int, y double").repartition(5)
    got = {r["feature"]: r["mutual_information"] for r in knn_mutual_information(
        frame, ["a", "b", "c"], F.col("y"), k, grid=1e-3, slice_rows=slice_rows).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == 0.0
    assert got["a"] == pytest.approx(brute(rows, 0, k), abs=1e-9)
    assert got["b"] == pytest.approx(brute(rows, 1, k), abs=1e-9)


def test_a_feature_that_decides_the_target_tells_most(spark):
    frame = spark.range(3000).selectExpr("id % 4 AS tells", "id % 7 AS silent", "id % 4 * 10 + rand(3) AS y")
    got = {r["feature"]: r["mutual_information"] for r in knn_mutual_information(frame, ["tells", "silent"], F.col("y")).collect()}
    assert got["tells"] == pytest.approx(1.386, abs=0.05) and got["silent"] < 0.05


def test_empty_frame(spark):
    frame = spark.createDataFrame([], "a string, y double")
    assert knn_mutual_information(frame, ["a"], F.col("y")).count() == 0


def test_windows_hold_a_slice_at_most(spark):
    rows = spark.range(5000).selectExpr("'f' AS feature", "'=x' AS _x", "id * id AS _y", "id AS _id", "5000L AS _n", "id AS _p")
    found = nearest_distance(rows, 5, slice_rows=100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_slice" in line for line in windows) and found.count() == 5000
    near = sorted(abs(i * i - 1_000_000) for i in range(990, 1010) if i != 1000)
    assert found.where("_id = 1000").first()["_r"] == near[4]


@pytest.mark.parametrize("slice_rows", [6, 40, 1000])
def test_common_targets_and_rare_values_across_slices(spark, slice_rows):
    made = random.Random(slice_rows)
    rows = [(made.choice("ab"), f"r{made.randrange(150)}", made.choice([1.0, 1.0, 7.0, made.random(), made.random()])) for _ in range(400)]
    got = {r["feature"]: r["mutual_information"] for r in knn_mutual_information(
        spark.createDataFrame(rows, "a string, b string, y double"), ["a", "b"], F.col("y"), 5, grid=1e-3, slice_rows=slice_rows).collect()}
    assert [got["a"], got["b"]] == pytest.approx([brute(rows, 0, 5), brute(rows, 1, 5)], abs=1e-9)


def test_most_rows_are_settled_in_their_slice(spark):
    """What leaves the slices is a small part of the rows, where all features' rows were sorted and written twice."""
    placed = spark.range(40_000).selectExpr("id div 10000 AS _slice", "id * 5 + id % 3 AS _y", "array(id % 4 + 1, id % 11 + 1) AS _c")
    found = information._slices_settled(placed, 2, 5, 3)
    assert 0 < found.where("_x > 0").count() < 0.03 * 2 * 40_000
    assert found.where("_x = 0 AND _near > 0").count() == 8


def test_digamma(spark):
    got = spark.range(1, 200).select("id", digamma(F.col("id")).alias("d")).collect()
    assert all(r["d"] == pytest.approx(psi(r["id"]), abs=1e-11) for r in got)


def test_a_row_moves_as_its_target_and_packed_values(spark):
    """13 features of up to 40 values take one or two whole numbers, not an array; slices are cut in order of the target."""
    made = random.Random(4)
    rows = [(*[f"v{made.randrange(2 + 3 * f)}" for f in range(13)], made.choice([5, made.randrange(1000)])) for _ in range(700)]
    names = [f"x{f}" for f in range(13)]
    known = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", _y long")
    sizes = known.select(F.posexplode(F.array(*names)).alias("feature", "_x")).groupBy("feature", "_x").agg(F.count("*").alias("_n"))
    coded, layout = information._coded(known, sizes, names)
    assert coded.columns == ["_y", "_p0"] and len(layout) == 13
    placed = information._sliced(coded, 50).toPandas()
    slices = placed.groupby("_slice")["_y"].agg(["min", "max", "size"]).sort_index()
    assert slices["size"].max() <= 50 and slices.index.tolist() == list(range(len(slices))) and len(placed) == 700
    assert (slices["max"].to_numpy()[:-1] <= slices["min"].to_numpy()[1:]).all()
    codes = information._codes(placed, layout)
    for f in range(13):  # as many values as before, each as often
        assert sorted(Counter(codes[:, f]).values()) == sorted(v for v in Counter(r[f] for r in rows).values())
