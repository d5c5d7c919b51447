"""Forecasts: no leak past the cutoff, inside the corridor, gates on short series."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.models import forecast as fc
from spendlake.models.regress import KernelRegression, Ridge
from spendlake.operators import events as ev
from spendlake.plans import outlook

CUTOFF, MONTHS = 202412, [202501, 202502, 202503]


def panel(spark, later=1.0):
    data = []
    for i in range(6):
        for m in range(27):
            ym = 202301 + m // 12 * 100 + m % 12
            level = 1e5 * (i + 1) * (1 + 0.3 * math.sin(2 * math.pi * (m % 12) / 12))
            data.append((f"S{i}", ym, level * (later if ym > CUTOFF else 1.0)))
    return spark.createDataFrame(data, "state string, year_month int, spend double")


@pytest.fixture(scope="module")
def dims(spark):
    reference = spark.createDataFrame([(f"S{i}", 1.0 + i, 10.0 * i + 1, 2.0, 30.0) for i in range(5)],
                                      "state string, population_m double, gdp_b double, tourism_b double, hotel_rooms_k double")
    events = spark.createDataFrame([("S0", 202502, "fair", 70.0), ("S1", 202402, "race", 50.0)],
                                   "state string, year_month int, name string, score double")
    uplift = spark.createDataFrame([("S0", 202502, 4.0)], "state string, year_month int, uplift_m double")
    return reference, events, uplift


def learners():
    return {"ridge": Ridge(1.0), "kernel": KernelRegression(ev.FEATURES, 32)}


def run(spark, dims, later):
    df, ensemble = outlook.run(panel(spark, later), *dims, CUTOFF, MONTHS, learners(), folds=3)
    return df.orderBy("state", "year_month").toPandas(), ensemble


def test_state_forecast(spark, dims):
    plain, ensemble = run(spark, dims, 1.0)
    wild, _ = run(spark, dims, 50.0)
    assert len(plain) == 6 * 3
    numbers = plain.columns[2:]
    assert np.allclose(plain[numbers], wild[numbers], rtol=1e-6), "rows after the cutoff changed the forecast"
    assert (plain["spend"] >= plain["floor"] - 1e-6).all()
    usual = plain[plain["floor"] <= plain["ceiling"]]
    assert (usual["spend"] <= usual["ceiling"] + 1e-6).all()
    assert (plain["low"] <= plain["high"]).all()
    hit = plain[(plain["state"] == "S0") & (plain["year_month"] == 202502)].iloc[0]
    assert hit["floor"] > 2.4e6 - 1
    assert abs(sum(ensemble.weights.values()) - 1) < 1e-9


def test_events_are_read_once_for_the_whole_outlook(spark, dims):
    reference, events, uplift = dims
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    n = events.count()
    outlook.run(panel(spark), reference, events.mapInPandas(counted, events.schema), uplift, CUTOFF, MONTHS,
                learners(), folds=3)[0].collect()
    assert read.value == 2 * n, "one pass for the scores, one for the counts"


def test_lag_cascade(spark):
    df = spark.createDataFrame([("A", 202301, 9.0), ("A", 202305, 99.0)], "state string, year_month int, spend double")
    first, second = ev.with_lags(df, ["state"]).orderBy("year_month").collect()
    assert (first.lag1, first.lag2, first.lag3) == (0.0, 0.0, 0.0)
    assert second.lag1 == second.lag2 == second.lag3 == math.log1p(9.0)


def test_unknown_state_takes_default_reference(spark, dims):
    row = ev.with_reference(spark.createDataFrame([("ZZ",)], "state string"), dims[0]).first()
    assert math.isclose(row.log_population, math.log1p(5.0)) and math.isclose(row.log_hotel_rooms, math.log1p(80.0))


@pytest.mark.parametrize("months,forecast", [(5, False), (6, False), (7, True)])
def test_segment_gate(spark, months, forecast):
    df = spark.createDataFrame([("s", 202401 + i, 100.0 + i) for i in range(months)],
                               "segment string, year_month int, spend double")
    assert (fc.forecast_segments(df, ["segment"], CUTOFF, MONTHS).count() > 0) is forecast


def test_segment_bounds_and_no_leak(spark):
    base = panel(spark).withColumnRenamed("state", "segment")
    wild = panel(spark, 40.0).withColumnRenamed("state", "segment")
    one = fc.forecast_segments(base, ["segment"], CUTOFF, MONTHS).orderBy("segment", "year_month").toPandas()
    two = fc.forecast_segments(wild, ["segment"], CUTOFF, MONTHS).orderBy("segment", "year_month").toPandas()
    assert one.equals(two)
    means = base.filter(F.col("year_month") <= CUTOFF).groupBy("segment").agg(F.avg("spend").alias("m")).toPandas()
    joined = one.merge(means, on="segment")
    assert (joined["spend"].between(joined["m"] * 0.6 - 1e-6, joined["m"] * 1.6 + 1e-6)).all()


def test_actual_and_forecast_series(spark):
    history = panel(spark).filter(F.col("year_month") <= CUTOFF).withColumnRenamed("state", "segment")
    ahead = fc.forecast_segments(history, ["segment"], CUTOFF, MONTHS)
    out = fc.actual_and_forecast(history, ahead, ["segment"])
    assert {r.kind: r["count"] for r in out.groupBy("kind").count().collect()} == {"actual": 144, "forecast": 18}
