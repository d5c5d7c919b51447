"""Order-based queries: lags, ranks, shares, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import events as ev, growth, mix, ranking, rollup, trend
from ..schema import ECOMM_STATUSES
from ..sources import star
from .base import (
    HORIZON, NOW, BEFORE, customer_spend, fact, month_total, query, r, segment_panel, sql,
    state_month, state_panel, state_totals,
)


@query("W01_cascading_lags", sql(f"""
SELECT state, year_month, {r('lag1', 6)} AS lag1, {r('lag2', 6)} AS lag2, {r('lag3', 6)} AS lag3 FROM lagged""", "lagged"))
def lags(spark, folder):
    df = ev.with_lags(state_month(spark, folder), ["state"])
    return df.select("state", "year_month", *[rounded(F.col(c), 6).alias(c) for c in ("lag1", "lag2", "lag3")])


@query("W02_lag_mean", sql(f"SELECT state, year_month, {r('roll3', 6)} AS roll3 FROM lagged", "lagged"))
def lag_mean(spark, folder):
    return ev.with_lags(state_month(spark, folder), ["state"]).select(
        "state", "year_month", rounded(F.col("roll3"), 6).alias("roll3"))


_RANKED = """(SELECT customer_id, total_spend, row_number() OVER w AS rank, sum(total_spend) OVER w AS cum_spend,
  sum(total_spend) OVER () AS total, count(*) OVER () AS n
  FROM customers WINDOW w AS (ORDER BY total_spend DESC, customer_id ROWS UNBOUNDED PRECEDING))"""


@query("W03_pareto", sql(f"""
SELECT customer_id, {r('total_spend')} AS total_spend, rank, {r('cum_spend')} AS cum_spend,
  {r('CAST(cum_spend * 100 AS DOUBLE) / CAST(total AS DOUBLE)', 6)} AS cum_pct,
  {r('rank / CAST(n AS DOUBLE) * 100', 6)} AS rank_pct FROM {_RANKED}""", "customers"))
def pareto(spark, folder):
    df = ranking.pareto(customer_spend(spark, folder), "customer_id")
    return df.select("customer_id", rounded(F.col("total_spend"), 4).alias("total_spend"), "rank",
                     rounded(F.col("cum_spend"), 4).alias("cum_spend"), rounded(F.col("cum_pct"), 6).alias("cum_pct"),
                     rounded(F.col("rank_pct"), 6).alias("rank_pct"))


_HELD = ", ".join(
    r(f"max(CAST(cum_spend * 100 AS DOUBLE) / CAST(total AS DOUBLE)) FILTER (rank <= greatest(floor(n * CAST({p} AS DOUBLE)), 1))", 6)
    + f" AS top_{int(p * 100)}pct" for p in (0.01, 0.1, 0.2))


@query("W04_concentration", sql(f"SELECT {_HELD} FROM {_RANKED}", "customers"))
def concentration(spark, folder):
    df = ranking.concentration(customer_spend(spark, folder), "customer_id")
    return df.select(*[rounded(F.col(c), 6).alias(c) for c in df.columns])


@query("W05_event_score", sql("SELECT state, year_month, event_score FROM ev_score", "ev_score"))
def event_score(spark, folder):
    return ev.event_scores(star.event_calendar(spark, folder))


@query("W06_event_count", sql("SELECT state, year_month, event_count, max_event FROM ev_count", "ev_count"))
def event_count(spark, folder):
    return ev.event_counts(star.event_calendar(spark, folder))


@query("W07_mean_rank", sql(f"""
SELECT cat_l2, {r('(ra + rb + rc) / 3.0', 6)} AS avg_rank
FROM (SELECT cat_l2, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
    rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb,
    rank() OVER (ORDER BY c DESC) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc
  FROM (SELECT cat_l2, sum(spend) AS a, count(DISTINCT cat_l3) AS b, count(DISTINCT state) AS c FROM fact GROUP BY ALL))
""", "fact"))
def mean_rank(spark, folder):
    cells = fact(spark, folder, "cat_l2", "cat_l3", "state", "spend").groupBy("cat_l2", "cat_l3", "state").agg(
        F.sum("spend").alias("spend"))  # distinct counts expand cells, not the fact
    df = cells.groupBy("cat_l2").agg(
        F.sum("spend").alias("a"), F.count_distinct("cat_l3").alias("b"), F.count_distinct("state").alias("c"))
    return ranking.mean_rank(df, "cat_l2", ["a", "b", "c"]).select(
        "cat_l2", rounded(F.col("avg_rank"), 6).alias("avg_rank"))


@query("W08_consensus_rank", sql(f"""
SELECT feature, {r('(sum(CASE WHEN rn <= 15 THEN rn END) + 15 * (any_value(k) - count(*) FILTER (rn <= 15))) / any_value(k)::DOUBLE', 6)} AS avg_rank
FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY v DESC, feature) AS rn
  FROM (SELECT segment AS method, cat_l2 AS feature, sum(spend) AS v FROM fact GROUP BY ALL)),
  (SELECT count(DISTINCT segment) AS k FROM fact)
GROUP BY feature HAVING count(*) FILTER (rn <= 15) > 0 ORDER BY 2, 1 LIMIT 10""", "fact"))
def consensus(spark, folder):
    long = fact(spark, folder, "segment", "cat_l2", "spend").groupBy(F.col("segment").alias("method"), F.col("cat_l2").alias("feature")).agg(F.sum("spend").alias("v"))
    return ranking.consensus_rank(long, "feature", "method", "v").withColumn(
        "avg_rank", rounded(F.col("avg_rank"), 6))


@query("W09_share_of_total", sql(f"""
SELECT state, cat_l1, {r('CAST(s AS DOUBLE) * 100 / CAST(sum(s) OVER (PARTITION BY state) AS DOUBLE)', 6)} AS share_pct
FROM (SELECT state, cat_l1, sum(spend) AS s FROM fact GROUP BY ALL)""", "fact"))
def share(spark, folder):
    df = fact(spark, folder, "state", "cat_l1", "spend").groupBy("state", "cat_l1").agg(F.sum("spend").alias("s"))
    return mix.with_share(df, "s", ["state"]).select("state", "cat_l1", rounded(F.col("share_pct"), 6).alias("share_pct"))


@query("W10_quarter_change", sql(f"""
SELECT state, quarter_no, {r('CAST(s AS DOUBLE)')} AS spend,
  {r('(CAST(s AS DOUBLE) - CAST(lag(s) OVER w AS DOUBLE)) / nullif(CAST(lag(s) OVER w AS DOUBLE), 0) * 100', 6)} AS qoq_pct
FROM (SELECT state, CAST(((year_month // 100) * 12 + year_month % 100 - 1) // 3 AS INTEGER) AS quarter_no, sum(spend) AS s
  FROM state_month GROUP BY ALL) WINDOW w AS (PARTITION BY state ORDER BY quarter_no)""", "state_month"))
def quarter_change(spark, folder):
    df = trend.quarter_change(growth.quarters(state_month(spark, folder), ["state"]), ["state"])
    return df.select("state", "quarter_no", rounded(F.col("spend"), 4).alias("spend"),
                     rounded(F.col("qoq_pct"), 6).alias("qoq_pct"))


@query("W11_row_number", sql(f"""
SELECT row_id, {r('spend')} AS spend, row_number() OVER (ORDER BY spend DESC, row_id) AS place FROM fact""", "fact"))
def row_number(spark, folder):
    df = fact(spark, folder, "row_id", "spend")
    return ranking.with_position(df, [F.desc("spend"), "row_id"], "place").withColumn(
        "spend", rounded(F.col("spend"), 4))


@query("W12_first_and_last", sql(f"""
SELECT state, {r('avg(y) FILTER (i <= 3)')} AS first_avg, {r('avg(y) FILTER (i > n - 3)')} AS last_avg
FROM (SELECT state, CAST(spend AS DOUBLE) AS y, row_number() OVER (PARTITION BY state ORDER BY year_month) AS i,
  count(*) OVER (PARTITION BY state) AS n FROM state_month) GROUP BY ALL""", "state_month"))
def first_last(spark, folder):
    df = trend.edge_means(state_month(spark, folder), ["state"])
    return df.select("state", *[rounded(F.col(c), 4).alias(c) for c in ("first_avg", "last_avg")])


@query("W13_active_rate", sql(f"""
SELECT segment, {r('avg(CASE WHEN x > med THEN 1.0 ELSE 0.0 END)', 6)} AS active_rate
FROM (SELECT segment, CAST(spend AS DOUBLE) AS x, median(CAST(spend AS DOUBLE)) OVER (PARTITION BY segment) AS med
  FROM dense WHERE month_no > (SELECT max(month_no) FROM dense) - 12) GROUP BY ALL""", "dense"))
def active_rate(spark, folder):
    dense = trend.densify(segment_panel(spark, folder), ["segment"])
    return trend.active_rate(dense, ["segment"]).withColumn("active_rate", rounded(F.col("active_rate"), 6))


@query("W14_step_delta", sql(f"""
SELECT year_month, {r('coalesce(spend - lag(spend) OVER (ORDER BY year_month), 0)')} AS delta FROM month_total""", "month_total"))
def step_delta(spark, folder):
    return trend.step_delta(month_total(spark, folder), "year_month", "spend").select(
        "year_month", rounded(F.col("delta"), 4).alias("delta"))


@query("W15_ordered_buckets", sql(f"""
SELECT CASE WHEN rooms < 100 THEN '<100 rooms' WHEN rooms < 250 THEN '100–250' WHEN rooms < 500 THEN '250–500'
  WHEN rooms < 1000 THEN '500–1000' ELSE '1000+' END AS size_bucket,
  CASE WHEN rooms < 100 THEN 1 WHEN rooms < 250 THEN 2 WHEN rooms < 500 THEN 3 WHEN rooms < 1000 THEN 4 ELSE 5 END AS size_no,
  count(*) AS customers FROM props GROUP BY ALL""", "props"))
def buckets(spark, folder):
    props = rollup.properties(fact(spark, folder, "segment", "customer_id", "rooms", "spend"))
    df = props.groupBy(rollup.size_bucket().alias("size_bucket")).agg(F.count("*").alias("customers"))
    return df.withColumn("size_no", rollup.size_order()).orderBy("size_no")


# Sorts, limits, top lists -------------------------------------------------------------

@query("T01_largest_customers", sql(f"""
SELECT customer_id, {r('total_spend')} AS total_spend FROM customers ORDER BY customers.total_spend DESC, customer_id LIMIT 25
""", "customers"))
def largest(spark, folder):
    return ranking.top_rows(customer_spend(spark, folder), 25, "total_spend", "customer_id").withColumn(
        "total_spend", rounded(F.col("total_spend"), 4))


@query("T02_sorted_head", sql(f"""
SELECT cat_l2, {r('s')} AS total_spend FROM (SELECT cat_l2, sum(spend) AS s FROM fact GROUP BY ALL) ORDER BY s, cat_l2 LIMIT 10
""", "fact"))
def sorted_head(spark, folder):
    df = rollup.key_stats(fact(spark, folder, "cat_l2", "spend"), "cat_l2")
    return ranking.top_rows(df, 10, "total_spend", "cat_l2", descending=False).select(
        "cat_l2", rounded(F.col("total_spend"), 4).alias("total_spend"))


@query("T03_top_with_other", sql(f"""
SELECT CASE WHEN rn <= 12 THEN cat_l2 ELSE 'Other' END AS cat_l2, {r('sum(s)')} AS spend
FROM (SELECT cat_l2, s, row_number() OVER (ORDER BY s DESC, cat_l2) AS rn
  FROM (SELECT cat_l2, sum(spend) AS s FROM fact GROUP BY ALL)) GROUP BY 1""", "fact"))
def top_other(spark, folder):
    df = fact(spark, folder, "cat_l2", "spend").groupBy("cat_l2").agg(F.sum("spend").alias("spend"))
    return ranking.top_with_other(df, 12, "cat_l2").withColumn("spend", rounded(F.col("spend"), 4))


@query("T04_top_pivot_rows", sql(f"""
SELECT cat_l2, {r("coalesce(sum(spend) FILTER (ecomm_status = 'ACTIVE'), 0)")} AS "ACTIVE",
  {r("coalesce(sum(spend) FILTER (ecomm_status = 'INACTIVE'), 0)")} AS "INACTIVE",
  {r("coalesce(sum(spend) FILTER (ecomm_status = 'PENDING'), 0)")} AS "PENDING"
FROM fact WHERE cat_l2 IN (SELECT cat_l2 FROM fact GROUP BY ALL ORDER BY sum(spend) DESC, cat_l2 LIMIT 10) GROUP BY ALL
""", "fact"))
def top_pivot(spark, folder):
    df = fact(spark, folder, "cat_l2", "ecomm_status", "spend")
    top = ranking.top_rows(rollup.key_stats(df, "cat_l2"), 10, "total_spend", "cat_l2").select("cat_l2")
    names = ECOMM_STATUSES
    wide = rollup.pivot_sum(df.join(top, "cat_l2", "left_semi"), ["cat_l2"], "ecomm_status", names)
    return wide.select("cat_l2", *[rounded(F.col(c), 4).alias(c) for c in names])


@query("T05_top_and_bottom_growth", sql(f"""
SELECT state, 'top' AS side, rn AS rank, {r('growth_pct', 6)} AS growth_pct
FROM (SELECT *, row_number() OVER (ORDER BY growth_pct DESC, state) AS rn FROM growth_pct) WHERE rn <= 10
UNION ALL SELECT state, 'bottom', rn, {r('growth_pct', 6)}
FROM (SELECT *, row_number() OVER (ORDER BY growth_pct, state DESC) AS rn FROM growth_pct) WHERE rn <= 10""", "growth_pct"))
def top_bottom(spark, folder):
    df = growth.period_growth(state_panel(spark, folder), ["state"], NOW, BEFORE)
    return ranking.top_and_bottom(df, 10, "growth_pct", "state").select(
        "state", "side", "rank", rounded(F.col("growth_pct"), 6).alias("growth_pct"))


_GRID = """FROM (SELECT DISTINCT state FROM state_tot) s CROSS JOIN (SELECT DISTINCT year_month FROM month_total) m
  LEFT JOIN ev_score e USING (state, year_month)"""


@query("T06_busiest_states", sql(f"""
SELECT state, {r('sum(coalesce(event_score, 0))')} AS total_score {_GRID} GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10
""", "ev_score", "state_tot", "month_total"))
def busiest(spark, folder):
    panel = state_panel(spark, folder)
    return ev.busiest_states(star.event_calendar(spark, folder), panel, trend.known_months(panel), 10)


@query("T07_best_event", sql(f"""
SELECT s.state, coalesce(e.name, '—') AS top_event, coalesce(e.score, 0.0) AS top_score
FROM (SELECT DISTINCT state FROM state_tot) s LEFT JOIN (
  SELECT state, name, score FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY score DESC, name) AS rn
    FROM ev WHERE year_month BETWEEN {HORIZON[0]} AND {HORIZON[-1]}) WHERE rn = 1) e USING (state)""", "ev", "state_tot"))
def best_event(spark, folder):
    return ev.best_event(star.event_calendar(spark, folder), state_totals(spark, folder), HORIZON[0], HORIZON[-1])
