"""Growth and period comparison. Months after the cutoff stand in for a forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import events as ev, growth, rollup, trend
from ..sources import star
from .base import (
    BEFORE, CUTOFF, HORIZON, NOW, month_total, query, r, segment_panel, sql, state_month, state_panel,
)


@query("G01_year_over_year", sql(f"""
SELECT state, {r('now_spend')} AS now_spend, {r('before_spend')} AS before_spend, {r('growth_pct', 6)} AS growth_pct
FROM growth_pct""", "growth_pct"))
def yoy(spark, folder):
    df = growth.period_growth(state_month(spark, folder), ["state"], NOW, BEFORE)
    return df.select("state", rounded(F.col("now_spend"), 4).alias("now_spend"),
                     rounded(F.col("before_spend"), 4).alias("before_spend"),
                     rounded(F.col("growth_pct"), 6).alias("growth_pct"))


@query("G02_lift_and_events", sql(f"""
SELECT g.state, {r('now_spend - before_spend')} AS yoy_lift, {r('coalesce(e.s, 0)')} AS event_score
FROM growth g LEFT JOIN (SELECT state, sum(event_score) AS s FROM ev_score
  WHERE year_month BETWEEN {NOW[0]} AND {NOW[1]} GROUP BY ALL) e USING (state)""", "growth", "ev_score"))
def lift(spark, folder):
    df = growth.lift_and_events(state_panel(spark, folder), star.event_calendar(spark, folder), NOW, BEFORE)
    return df.select("state", rounded(F.col("yoy_lift"), 4).alias("yoy_lift"),
                     rounded(F.col("event_score"), 4).alias("event_score"))


HALF = (200007, CUTOFF)

_HALVES = f"""
SELECT segment, {r('prior_h2')} AS prior_h2, {r('h1')} AS h1,
  {r('CAST((h1 - prior_h2) * 100 AS DOUBLE) / nullif(CAST(prior_h2 AS DOUBLE), 0)', 6)} AS h1_vs_prior_h2
FROM (SELECT segment, CASE WHEN count(*) < 12 THEN sum(spend)
    ELSE sum(spend) FILTER (year_month BETWEEN {HALF[0]} AND {HALF[1]}) END AS prior_h2
  FROM seg_month WHERE year_month <= {CUTOFF} GROUP BY ALL)
JOIN (SELECT segment, sum(spend) AS h1 FROM seg_month WHERE year_month BETWEEN {HORIZON[0]} AND {HORIZON[-1]} GROUP BY ALL)
  USING (segment)"""


@query("G03_half_year", sql(_HALVES, "seg_month"))
def half_year(spark, folder):
    panel = segment_panel(spark, folder)
    df = growth.half_year_growth(panel.filter(F.col("year_month") <= CUTOFF),
                                 panel.filter(F.col("year_month").between(HORIZON[0], HORIZON[-1])), ["segment"], HALF)
    return df.select("segment", rounded(F.col("prior_h2"), 4).alias("prior_h2"), rounded(F.col("h1"), 4).alias("h1"),
                     rounded(F.col("h1_vs_prior_h2"), 6).alias("h1_vs_prior_h2"))


@query("G04_segment_panel", sql(f"""
SELECT segment, {r('CAST(sum(spend) AS DOUBLE) / count(*)', 2)} AS avg_monthly,
  arg_max(year_month, (spend, -year_month)) AS peak_month, {r('max(spend)')} AS peak_value
FROM seg_month WHERE year_month <= {CUTOFF} GROUP BY ALL""", "seg_month"))
def panel_stats(spark, folder):
    history = segment_panel(spark, folder).filter(F.col("year_month") <= CUTOFF)
    means = history.groupBy("segment").agg((F.sum("spend").cast("double") / F.count("*")).alias("avg_monthly"))
    return means.join(rollup.extremes(history, ["segment"]), "segment").select(
        "segment", rounded(F.col("avg_monthly"), 2).alias("avg_monthly"), "peak_month",
        rounded(F.col("peak_value"), 4).alias("peak_value"))


@query("G05_portfolio_lift", sql(f"""
SELECT {r('sum(now_spend)')} AS now_spend, {r('sum(before_spend)')} AS before_spend,
  {r('CAST((sum(now_spend) - sum(before_spend)) * 100 AS DOUBLE) / CAST(sum(before_spend) AS DOUBLE)', 6)} AS lift_pct
FROM growth""", "growth"))
def portfolio_lift(spark, folder):
    df = growth.period_growth(month_total(spark, folder), [], NOW, BEFORE)
    return df.select(rounded(F.col("now_spend"), 4).alias("now_spend"),
                     rounded(F.col("before_spend"), 4).alias("before_spend"),
                     rounded(F.col("growth_pct"), 6).alias("lift_pct"))


@query("G06_event_spend_detail", sql(f"""
SELECT s.state, m.year_month, coalesce(e.event_score, 0) AS event_score, {r('coalesce(u.uplift_m, 0)')} AS uplift_m,
  {r('coalesce(p.spend, 0)')} AS spend, CASE WHEN coalesce(e.event_score, 0) >= 60 THEN 'high'
    WHEN coalesce(e.event_score, 0) >= 25 THEN 'medium' ELSE 'low' END AS severity, v.name, v.score
FROM (SELECT DISTINCT state FROM state_month) s
CROSS JOIN (SELECT DISTINCT year_month FROM month_total WHERE year_month BETWEEN {HORIZON[0]} AND {HORIZON[-1]}) m
LEFT JOIN ev_score e USING (state, year_month) LEFT JOIN uplift u USING (state, year_month)
LEFT JOIN state_month p USING (state, year_month) LEFT JOIN ev v USING (state, year_month)
""", "state_month", "month_total", "ev_score", "uplift", "ev"))
def event_spend(spark, folder):
    panel = state_panel(spark, folder)
    ahead = panel.filter(F.col("year_month").between(HORIZON[0], HORIZON[-1]))
    spine = ev.state_month_spine(panel, trend.known_months(ahead))
    inside = F.col("year_month").between(HORIZON[0], HORIZON[-1])  # before anything is shuffled
    df = ev.event_detail(spine, star.event_calendar(spark, folder).filter(inside),
                         star.event_uplift(spark, folder).filter(inside), panel)
    return df.select("state", "year_month", "event_score", rounded(F.col("uplift_m"), 4).alias("uplift_m"),
                     rounded(F.col("spend"), 4).alias("spend"), "severity", "name", "score")


@query("G07_rankings", sql(f"""
SELECT state, {r('now_spend')} AS now_spend, {r('growth_pct', 6)} AS growth_pct,
  coalesce(e.name, '—') AS top_event, row_number() OVER (ORDER BY growth_pct DESC, state) AS rank
FROM growth_pct LEFT JOIN (SELECT state, name FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY score DESC, name) AS rn
  FROM ev WHERE year_month BETWEEN {NOW[0]} AND {NOW[1]}) WHERE rn = 1) e USING (state)""", "growth_pct", "ev"))
def rankings(spark, folder):
    df = growth.rankings(state_panel(spark, folder), star.event_calendar(spark, folder), NOW, BEFORE)
    return df.select("state", rounded(F.col("now_spend"), 4).alias("now_spend"),
                     rounded(F.col("growth_pct"), 6).alias("growth_pct"), "top_event", "rank")


@query("G08_quarter_table", sql(f"""
SELECT segment, coalesce(l.label, segment) AS label, quarter_no, {r('s')} AS spend,
  {r('(CAST(s AS DOUBLE) - CAST(lag(s) OVER w AS DOUBLE)) / nullif(CAST(lag(s) OVER w AS DOUBLE), 0) * 100', 6)} AS qoq_pct
FROM (SELECT segment, CAST(((year_month // 100) * 12 + year_month % 100 - 1) // 3 AS INTEGER) AS quarter_no, sum(spend) AS s
  FROM seg_month GROUP BY ALL) LEFT JOIN labels l USING (segment)
WHERE segment IN (SELECT segment FROM (SELECT segment, sum(spend) AS q FROM seg_month
  GROUP BY segment, ((year_month // 100) * 12 + year_month % 100 - 1) // 3) WHERE q > 50000)
WINDOW w AS (PARTITION BY segment ORDER BY quarter_no)""", "seg_month", "labels"))
def quarter_table(spark, folder):
    df = growth.quarter_table(segment_panel(spark, folder), star.segment_labels(spark, folder))
    return df.select("segment", "label", "quarter_no", rounded(F.col("spend"), 4).alias("spend"),
                     rounded(F.col("qoq_pct"), 6).alias("qoq_pct"))
