"""Period comparison: same-period growth, lift against events, quarters, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import month_index, quarter_label
from .clean import with_label
from .events import best_event, event_scores
from .ranking import with_position
from .trend import growth_pct, quarter_change


def actual_or_forecast(actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Actual spend where a month has it, else the forecast, else 0."""
    left = actual.select(*keys, "year_month", F.col("spend").alias("actual"))
    right = forecast.select(*keys, "year_month", F.col("spend").alias("forecast"))
    merged = left.join(right, [*keys, "year_month"], "full")
    return merged.withColumns({
        "spend": F.coalesce("actual", "forecast", F.lit(0)),
        "is_forecast": F.col("actual").isNull().cast("int")}).drop("actual", "forecast")


def period_growth(series: DataFrame, keys: list[str], now: tuple[int, int],
                  before: tuple[int, int]) -> DataFrame:
    """Spend of two periods and growth %, in one pass over the series."""
    part = lambda span: F.sum(F.when(F.col("year_month").between(*span), F.col("spend"))
                              .otherwise(F.lit(0)))
    inside = series.filter(F.col("year_month").between(*before)
                           | F.col("year_month").between(*now))
    out = inside.groupBy(*keys).agg(part(now).alias("now_spend"), part(before).alias("before_spend"))
    return out.withColumn("growth_pct", growth_pct(F.col("now_spend"), F.col("before_spend")))


def lift_and_events(series: DataFrame, events: DataFrame, now: tuple[int, int],
                    before: tuple[int, int]) -> DataFrame:
    """Dollar lift of a period over the same period a year before, with its event score."""
    growth = period_growth(series, ["state"], now, before)
    scores = (event_scores(events).filter(F.col("year_month").between(*now)).groupBy("state")
              .agg(F.round(F.sum("event_score"), 4).alias("event_score")))
    return (growth.join(scores, "state", "left").fillna({"event_score": 0.0})
            .withColumn("yoy_lift", F.col("now_spend") - F.col("before_spend")))


def half_year_growth(history: DataFrame, forecast: DataFrame, keys: list[str],
                     half: tuple[int, int]) -> DataFrame:
    """First-half forecast against the half year before it, given by its first and last month.

    A series of fewer than 12 known months is compared with all of its history.
    """
    inside = F.sum(F.when(F.col("year_month").between(*half), F.col("spend")))
    base = history.groupBy(*keys).agg(
        F.when(F.count("*") < 12, F.sum("spend")).otherwise(inside).alias("prior_h2"),
        F.avg("spend").alias("avg_monthly"))
    ahead = forecast.groupBy(*keys).agg(F.sum("spend").alias("h1"))
    return base.join(ahead, keys).withColumn(
        "h1_vs_prior_h2", growth_pct(F.col("h1"), F.col("prior_h2")))


def quarters(series: DataFrame, keys: list[str]) -> DataFrame:
    """Months -> quarters, with a running quarter number for ordering."""
    number = F.floor(month_index("year_month") / 3).cast("int")
    return series.groupBy(*keys, quarter_label("year_month").alias("quarter"),
                          number.alias("quarter_no")).agg(F.sum("spend").alias("spend"))


def quarter_table(series: DataFrame, labels: DataFrame, threshold: float = 50_000.0) -> DataFrame:
    """Quarter spend and change per segment, segments whose best quarter passes the threshold."""
    by_quarter = quarters(series, ["segment"])
    large = (by_quarter.groupBy("segment").agg(F.max("spend").alias("_best"))
             .filter(F.col("_best") > threshold).select("segment"))
    kept = by_quarter.join(large, "segment", "left_semi")
    return quarter_change(with_label(kept, labels).withColumn("label", F.left("label", F.lit(32))),
                          ["segment"])


def rankings(series: DataFrame, events: DataFrame, now: tuple[int, int],
             before: tuple[int, int]) -> DataFrame:
    """Growth per state with its best event of the period, ranked. Runs one job."""
    growth = period_growth(series, ["state"], now, before)
    named = growth.join(best_event(events, growth, *now), "state")
    return with_position(named, [F.desc("growth_pct"), "state"], "rank")
