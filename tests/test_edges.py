"""Hand-made frames for the rules that ordinary data does not reach."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spendlake.functions import clamp, coerce_number, money, parse_year_month, ratio_or_zero
from spendlake.models.forecast import corridor
from spendlake.operators import clean, events as ev, growth, mix, ranking, rollup, stats, trend


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def series(spark, **values):
    data = [(k, 200001 + i, float(v)) for k, vs in values.items() for i, v in enumerate(vs) if v is not None]
    return spark.createDataFrame(data, "segment string, year_month int, spend double")


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1,234",), (" 12 ",), ("abc",), (None,), ("7.5",)], "t string")
    assert [r[0] for r in df.select(coerce_number("t")).collect()] == [0.0, 12.0, 0.0, 0.0, 7.5]


def test_months_from_text(spark):
    df = spark.createDataFrame([("202501",), ("2025-01",), ("202501.0",), ("2025-13",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_year_month("t")).collect()] == [202501, 202501, 202501, None, None, None]


def test_clamp_floor_wins_and_nulls_stay(spark):
    df = spark.createDataFrame([(5.0, 8.0, 6.0), (9.0, 1.0, 6.0), (None, 1.0, 2.0)], "x double, lo double, hi double")
    assert [r[0] for r in df.select(clamp(F.col("x"), F.col("lo"), F.col("hi"))).collect()] == [8.0, 6.0, None]


def test_money_text(spark):
    df = spark.createDataFrame([(1.5e9,), (-2.25e6,), (7540.0,), (12.4,), (None,)], "v double")
    assert [r[0] for r in df.select(money("v")).collect()] == ["$1.50B", "$-2.25M", "$7.5K", "$12", "—"]


def test_ratio_with_zero_base(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio_or_zero(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.5]


def test_trend_of_short_constant_and_empty_series(spark):
    df = series(spark, flat=[5, 5, 5, 5], up=[1, 2, 3, 4], nothing=[0, 0, 0, 0])
    out = rows(trend.trend_features(trend.densify(df, ["segment"]), ["segment"]), "segment")
    assert (out["flat"].r2, out["flat"].volatility, out["flat"].slope) == (0.0, 0.0, 0.0)
    assert math.isclose(out["up"].slope, 1.0) and math.isclose(out["up"].r2, 1.0)
    assert math.isclose(out["up"].momentum, 0.5) and out["up"].best_month == 3 and out["up"].worst_month == 0
    assert out["nothing"].momentum == 0.0 and out["nothing"].slope_norm == 0.0
    one = trend.trend_features(trend.densify(series(spark, one=[7]), ["segment"]), ["segment"]).first()
    assert (one.slope, one.r2, one.momentum, one.q1_avg, one.q4_avg, one.best_month) == (0, 0, 0, 7.0, 7.0, 0)


def test_missing_month_counts_as_zero_only_when_dense(spark):
    df = series(spark, a=[4, None, 4], b=[1, 1, 1])
    dense = rows(trend.densify(df, ["segment"]).groupBy("segment").agg(F.avg("spend").alias("m")), "segment")
    present = rows(df.groupBy("segment").agg(F.avg("spend").alias("m")), "segment")
    assert math.isclose(dense["a"].m, 8 / 3) and present["a"].m == 4.0


def test_null_keys_are_dropped(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 9.0)], "segment string, spend double")
    assert [r.segment for r in rollup.key_stats(df, "segment").collect()] == ["a"]
    assert [r.segment for r in rollup.value_counts(df, "segment").collect()] == ["a"]


def test_event_ties_and_quiet_states(spark):
    events = spark.createDataFrame(
        [("A", 202501, "z", 40.0), ("A", 202501, "y", 40.0), ("A", 202501, "x", 20.0)],
        "state string, year_month int, name string, score double")
    assert ev.event_scores(events).first().event_score == 40 + 20 + 5
    states = spark.createDataFrame([("A",), ("B",)], "state string")
    best = rows(ev.best_event(events, states, 202501, 202503), "state")
    assert best["A"].top_event == "y" and best["B"].top_event == "—" and best["B"].top_score == 0.0
    grid = rows(ev.score_grid(events, states, F.array(F.lit(202501))), "state")
    assert grid["B"].event_score == 0.0


def test_many_events_in_one_cell(spark):
    """A hot cell keeps its exact score: ranks beyond the carried digits weigh nothing."""
    events = spark.range(5000).select(
        F.lit("A").alias("state"), F.lit(202501).alias("year_month"),
        F.col("id").cast("string").alias("name"), (F.col("id") % 101).cast("double").alias("score"))
    scores = sorted((i % 101 for i in range(5000)), reverse=True)
    assert math.isclose(ev.event_scores(events).first().event_score,
                        sum(s * 0.5 ** i for i, s in enumerate(scores)), abs_tol=1e-3)


@pytest.mark.parametrize("uplift,score,prior,floor,ceiling", [
    (0.0, 0.0, 0.0, 65.0, 155.0),
    (1.0, 0.0, 100.0, 90.0, 155.0),
    (0.5, 10.0, 100.0, 90.0, 115.0),
    (2.0, 0.0, 0.0, 65.0, 165.0),
    (3.0, 0.0, 0.0, 100.0 + 1.8e6, 165.0),
    (3.0, 0.0, 100.0, 100.0 + 1.8e6, 100.0 + 3e6),
    (5.0, 0.0, 0.0, 100.0 + 3e6, 180.0),
    (8.0, 0.0, 0.0, 100.0 + 4.8e6, 220.0),
    (0.5, 40.0, 100.0, 90.0, 155.0),
])
def test_corridor(spark, uplift, score, prior, floor, ceiling):
    lo, hi = corridor(*[F.lit(float(v)) for v in (100.0, uplift, score, prior)])
    row = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert math.isclose(row.lo, floor) and math.isclose(row.hi, ceiling)


def test_growth_with_zero_base(spark):
    df = series(spark, a=[0, 0, 5]).withColumnRenamed("segment", "state")
    out = growth.period_growth(df, ["state"], (200003, 200003), (200001, 200002)).first()
    assert out.growth_pct == 0.0
    table = trend.quarter_change(spark.createDataFrame(
        [("a", 1, 0.0), ("a", 2, 5.0), ("a", 3, 10.0)], "k string, quarter_no int, spend double"), ["k"])
    assert [r.qoq_pct for r in table.orderBy("quarter_no").collect()] == [None, None, 100.0]


def test_half_year_of_long_and_short_series(spark):
    history = series(spark, long=list(range(1, 13)), short=[1, 2, 3])
    ahead = series(spark, long=[10] * 6, short=[1] * 6)
    out = rows(growth.half_year_growth(history, ahead, ["segment"], (200007, 200012)), "segment")
    assert out["long"].prior_h2 == sum(range(7, 13)) and out["short"].prior_h2 == 6.0


def test_half_year_of_three_years(spark):
    months = [y * 100 + m for y in (2000, 2001, 2002) for m in range(1, 13)]
    history = spark.createDataFrame([("a", ym, float(i)) for i, ym in enumerate(months)], "segment string, year_month int, spend double")
    ahead = spark.createDataFrame([("a", 200301, 1.0)], "segment string, year_month int, spend double")
    out = growth.half_year_growth(history, ahead, ["segment"], (200207, 200212)).first()
    assert out.prior_h2 == sum(range(30, 36))


def test_unknown_label_and_default_row(spark):
    df = spark.createDataFrame([("a",), ("b",)], "segment string")
    labels = spark.createDataFrame([("a", "Alpha")], "segment string, label string")
    assert {r.segment: r.label for r in clean.with_label(df, labels).collect()} == {"a": "Alpha", "b": "b"}
    lookup = spark.createDataFrame([("a", 9.0)], "segment string, x double")
    out = clean.with_defaults(df, lookup, ["segment"], {"x": 5.0})
    assert {r.segment: r.x for r in out.collect()} == {"a": 9.0, "b": 5.0}


def test_mix_fills_missing_categories(spark):
    df = spark.createDataFrame([("s", "x", 1.0), ("s", "x", 1.0), ("t", "y", 2.0)], "segment string, cat_l1 string, spend double")
    out = rows(mix.mix_against_national(mix.category_mix(df), mix.national_mix(df)), "segment", "cat_l1")
    assert out[("s", "y")].segment_pct == 0.0 and out[("s", "y")].delta_pp == -50.0


def test_gini_and_pareto_edges(spark):
    one = spark.createDataFrame([("a", 5.0)], "k string, total_spend double")
    assert abs(ranking.gini(one, "k").first().gini) < 1e-12
    assert ranking.concentration(one, "k").first().top_1pct == 100.0
    equal = spark.createDataFrame([(f"k{i}", 1.0) for i in range(10)], "k string, total_spend double")
    assert abs(ranking.gini(equal, "k").first().gini) < 1e-12
    assert [r.k for r in ranking.pareto(equal, "k").orderBy("rank").collect()] == [f"k{i}" for i in range(10)]
    assert math.isclose(ranking.concentration(equal, "k", shares=(0.2,)).first().top_20pct, 20.0)
    assert math.isclose(ranking.concentration(equal, "k", shares=(0.2,), compat=True).first().top_20pct, 30.0)


def test_correlation_of_a_constant_and_p_values(spark):
    df = spark.createDataFrame([(float(i), 3.0, float(i * 2 + (i % 3)), float(i)) for i in range(12)],
                               "total_spend double, flat double, near double, x double")
    out = rows(stats.factor_correlation(df, ["flat", "near", "x"]), "factor")
    assert out["flat"].pearson_r is None and out["flat"].p_value is None
    assert math.isclose(out["x"].pearson_r, 1.0) and out["x"].p_value < 1e-12
    assert out["near"].significant
    # t distribution table: r = 0.5760 at n = 12 is the two-sided 5 % point.
    p = spark.range(1).select(stats.correlation_p_value(F.lit(0.5760), F.lit(12))).first()[0]
    assert math.isclose(p, 0.05, abs_tol=5e-4)


def test_moments_against_pandas(spark):
    import numpy as np
    import pandas as pd
    x = pd.Series(np.random.default_rng(1).gamma(2.0, 1.0, 200))
    out = stats.residual_moments(spark.createDataFrame(x.to_frame("e")), "e").first()
    assert math.isclose(out["skew"], x.skew(), rel_tol=1e-9)
    assert math.isclose(out["kurtosis"], x.kurt(), rel_tol=1e-9)
    tiny = stats.residual_moments(spark.createDataFrame([(1.0,), (1.0,)], "e double"), "e").first()
    assert tiny["skew"] is None and tiny["kurtosis"] is None


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert {r.bin: r.n for r in stats.histogram(df, "v", 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [(r.bin, r.n) for r in stats.histogram(same, "v", 5).collect()] == [(0, 4)]


def test_event_list_text_and_count(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "events array<string>")
    assert [(r.major_events, r.event_count) for r in clean.with_event_list(df).collect()] == [("a; b", 2), ("", 0)]


def test_snake_case(spark):
    from spendlake.sources import files
    assert files.snake_case(spark.createDataFrame([(1, 2)], "`Year Month` int, State int")).columns == ["year_month", "state"]
