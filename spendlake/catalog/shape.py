"""Projections, filters, joins, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import (
    add_months, clamp, clean_label, money, month_label, month_of,
    parse_year_month, ratio_or_zero, rounded, season_cos, season_sin, standard_score, unit_scale,
    year_of,
)
from ..models.regress import align_importances
from ..operators import clean, events as ev, growth, mix, rollup, trend
from ..operators.ranking import top_rows
from ..plans import marts
from ..schema import DEFAULT_REFERENCE
from ..session import settle
from ..sources import star
from .base import (
    CATEGORIES, CUTOFF, STATES, YEAR, customer_spend, fact, full_segment_month, mix_cells, month_total, query, r,
    segment_panel, sql, state_month, state_panel, state_totals,
)

# Projections, filters, predicates -----------------------------------------------------

# Text amounts as they come in exports: grouped digits, blanks, words, nulls.
_TEXT_SPEND = """CASE o_orderkey % 5 WHEN 0 THEN '1,234' WHEN 1 THEN ' ' || CAST(o_orderkey AS VARCHAR) || ' '
  WHEN 2 THEN 'abc' WHEN 3 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) || '.5' END"""


@query("P01_coerce_numbers", f"""
SELECT o_orderpriority AS entity_type, count(*) AS n,
  {r("sum(coalesce(TRY_CAST(CAST(t AS VARCHAR) AS DOUBLE), 0))")} AS spend
FROM (SELECT o_orderpriority, {_TEXT_SPEND} AS t FROM orders) GROUP BY ALL""")
def coerce_numbers(spark, folder):
    key = F.col("o_orderkey")
    text = (F.when(key % 5 == 0, "1,234").when(key % 5 == 1, F.concat(F.lit(" "), key.cast("string"), F.lit(" ")))
            .when(key % 5 == 2, "abc").when(key % 5 == 4, F.concat(key.cast("string"), F.lit(".5"))))
    df = star.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("entity_type"), text.alias("t"))
    return (clean.coerce_numbers(df, ["t"]).groupBy("entity_type")
            .agg(F.count("*").alias("n"), rounded(F.sum("t"), 4).alias("spend")))


@query("P02_positive_spend", sql(f"""
SELECT segment, count(*) AS n, {r('sum(adj)')} AS spend
FROM (SELECT segment, CASE WHEN cat_l3 = '0' THEN NULL WHEN cat_l3 = '1' THEN -spend ELSE spend END AS adj FROM fact)
WHERE adj IS NOT NULL AND adj > 0 GROUP BY segment""", "fact"))
def positive_spend(spark, folder):
    df = fact(spark, folder, "segment", "cat_l3", "spend").withColumn(
        "adj", F.when(F.col("cat_l3") == "1", -F.col("spend")).when(F.col("cat_l3") != "0", F.col("spend")))
    return clean.positive_spend(df, "adj").groupBy("segment").agg(
        F.count("*").alias("n"), rounded(F.sum("adj"), 4).alias("spend"))


@query("P03_fill_unknown", sql("""
SELECT coalesce(cat_l4, 'UNKNOWN') AS cat_l4, count(*) AS n FROM fact GROUP BY ALL""", "fact"))
def fill_unknown(spark, folder):
    return (clean.fill_unknown(fact(spark, folder, "cat_l4"), ["cat_l4"]).groupBy("cat_l4")
            .agg(F.count("*").alias("n")))


@query("P04_purchase_flags", sql(f"""
SELECT CASE WHEN rooms IS NOT NULL THEN 1 ELSE 0 END AS has_rooms,
  CASE WHEN lower(ecomm_status) = 'active' THEN 1 ELSE 0 END AS is_ecomm_active,
  count(*) AS n, {r('sum(coalesce(rooms, 0))')} AS room_sum FROM fact GROUP BY ALL""", "fact"))
def flags(spark, folder):
    df = clean.purchase_flags(fact(spark, folder, "rooms", "ecomm_status"))
    return df.groupBy("has_rooms", "is_ecomm_active").agg(
        F.count("*").alias("n"), rounded(F.sum("room_count"), 4).alias("room_sum"))


@query("P05_category_depth", sql("""
SELECT CAST((cat_l1 IS NOT NULL)::INT + (cat_l2 IS NOT NULL)::INT + (cat_l3 IS NOT NULL)::INT
  + (cat_l4 IS NOT NULL)::INT AS INTEGER) AS depth, count(*) AS n FROM fact GROUP BY ALL""", "fact"))
def depth(spark, folder):
    df = fact(spark, folder, "cat_l1", "cat_l2", "cat_l3", "cat_l4")
    return df.groupBy(clean.category_depth().alias("depth")).agg(F.count("*").alias("n"))


@query("P06_month_range", sql(f"""
SELECT year_month, {r('sum(spend)')} AS spend FROM fact
WHERE year_month BETWEEN {YEAR[0]} AND {YEAR[1]} GROUP BY ALL""", "fact"))
def month_range(spark, folder):
    df = clean.months_between(fact(spark, folder, "year_month", "spend"), *YEAR)
    return df.groupBy("year_month").agg(rounded(F.sum("spend"), 4).alias("spend"))


@query("P07_membership", sql(f"""
SELECT state, count(*) AS n FROM fact WHERE state IN ({', '.join(f"'{s}'" for s in STATES)})
  AND cat_l2 IN (SELECT p_brand FROM part WHERE p_size > 49) GROUP BY ALL""", "fact"))
def membership(spark, folder):
    df = clean.only_members(fact(spark, folder, "state", "cat_l2"), "state", STATES)
    brands = star.table(spark, folder, "part").filter("p_size > 49").select("p_brand")
    return clean.only_members(df, "cat_l2", brands).groupBy("state").agg(F.count("*").alias("n"))


@query("P08_key_filter", sql(f"""
SELECT year_month, {r('spend')} AS spend FROM state_month WHERE state = 'NATION_7'""", "state_month"))
def key_filter(spark, folder):
    df = state_month(spark, folder).filter(F.col("state") == "NATION_7")
    return df.select("year_month", rounded(F.col("spend"), 4).alias("spend"))


@query("P09_drop_missing", sql(f"""
SELECT segment, count(*) AS n, {r('sum(spend)')} AS spend FROM fact
WHERE rooms IS NOT NULL AND cat_l4 IS NOT NULL GROUP BY ALL""", "fact"))
def drop_missing(spark, folder):
    df = clean.known_keys(fact(spark, folder, "segment", "rooms", "cat_l4", "spend"), ["rooms", "cat_l4"])
    return df.groupBy("segment").agg(F.count("*").alias("n"), rounded(F.sum("spend"), 4).alias("spend"))


_CELLS = ", ".join(f"coalesce(sum(spend) FILTER (cat_l1 = '{c}'), 0) AS {c}" for c in
                   CATEGORIES)


@query("P10_row_max_filter", sql(f"""
SELECT customer_id, {", ".join(f"{r(c)} AS {c}" for c in CATEGORIES)}
FROM (SELECT customer_id, {_CELLS} FROM fact GROUP BY ALL)
WHERE greatest({", ".join(CATEGORIES)}) > 200000""", "fact"))
def row_max(spark, folder):
    wide = rollup.pivot_sum(fact(spark, folder, "customer_id", "cat_l1", "spend"), ["customer_id"], "cat_l1", CATEGORIES)
    return clean.above_row_max(wide, CATEGORIES, 200_000.0).select(
        "customer_id", *[rounded(F.col(c), 4).alias(c) for c in CATEGORIES])


@query("P11_per_unit", sql(f"""
SELECT s.state, {r('CAST(total_spend AS DOUBLE) / nullif(population_m * 1e6, 0)', 8)} AS per_capita,
  {r('CAST(total_spend AS DOUBLE) / nullif(hotel_rooms_k * 1e3, 0)')} AS per_room
FROM state_tot s JOIN ref USING (state)""", "state_tot", "ref"))
def per_unit(spark, folder):
    df = state_totals(spark, folder).join(star.state_reference(spark, folder), "state")
    return clean.per_unit(df).select(
        "state", rounded(F.col("spend_per_capita"), 8).alias("per_capita"),
        rounded(F.col("spend_per_hotel_room"), 4).alias("per_room"))


_CLASS = f"""
SELECT t.segment, {r('total_spend', 2)} AS total_spend, {r('momentum', 6)} AS momentum,
  CASE WHEN total_spend >= med AND momentum > 0 THEN 'Protect & Grow'
    WHEN momentum > 0 THEN 'Emerging Opportunity' WHEN total_spend >= med THEN 'Revenue at Risk'
    ELSE 'Monitor' END AS strategic_class,
  CASE WHEN momentum > 0.05 THEN 'Growing' WHEN momentum < -0.05 THEN 'Declining' ELSE 'Stable' END AS growth_signal
FROM (SELECT segment, CAST(sum(spend) AS DOUBLE) AS total_spend FROM fact GROUP BY ALL) t
  JOIN trend USING (segment)
  CROSS JOIN (SELECT median(x) AS med FROM (SELECT CAST(sum(spend) AS DOUBLE) AS x FROM fact GROUP BY segment))"""


@query("P12_strategic_class", sql(_CLASS, "fact", "trend"))
def strategic(spark, folder):
    return marts.segment_features(settle(full_segment_month(spark, folder))).select(
        "segment", rounded(F.col("total_spend"), 2).alias("total_spend"),
        rounded(F.col("momentum"), 6).alias("momentum"), "strategic_class", "growth_signal")


@query("P13_growth_signal", sql(f"""
SELECT state, {r('momentum', 6)} AS momentum, CASE WHEN momentum > 0.05 THEN 'Growing'
  WHEN momentum < -0.05 THEN 'Declining' ELSE 'Stable' END AS growth_signal
FROM (SELECT state, (avg(y) FILTER (i > n - 3) - avg(y) FILTER (i <= 3)) / avg(y) FILTER (i <= 3) AS momentum
  FROM (SELECT state, CAST(spend AS DOUBLE) AS y, row_number() OVER (PARTITION BY state ORDER BY year_month) AS i,
      count(*) OVER (PARTITION BY state) AS n FROM state_month) GROUP BY state)""", "state_month"))
def signal(spark, folder):
    edges = trend.edge_means(state_month(spark, folder), ["state"])
    df = edges.withColumn("momentum", (F.col("last_avg") - F.col("first_avg")) / F.col("first_avg"))
    return df.select("state", rounded(F.col("momentum"), 6).alias("momentum"),
                     trend.growth_signal().alias("growth_signal"))


@query("P14_high_average", sql(f"""
SELECT customer_id, year_month, {r('a', 2)} AS avg_spend
FROM (SELECT customer_id, year_month, CAST(sum(spend) AS DOUBLE) / count(spend) AS a FROM fact GROUP BY ALL)
WHERE a > 2 * (SELECT avg(a) FROM (SELECT CAST(sum(spend) AS DOUBLE) / count(spend) AS a FROM fact
  GROUP BY customer_id, year_month))""", "fact"))
def high_average(spark, folder):
    cells = fact(spark, folder, "customer_id", "year_month", "spend").groupBy("customer_id", "year_month").agg(
        (F.sum("spend").cast("double") / F.count("spend")).alias("a"))
    return clean.far_above_mean(cells, "a", 2.0).select(
        "customer_id", "year_month", rounded(F.col("a"), 2).alias("avg_spend"))


# Concentration of a segment: share of its spend with its largest client.
_RISK = """(SELECT segment, CAST(max(c) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS held FROM
  (SELECT segment, client_id, sum(spend) AS c FROM fact GROUP BY ALL) GROUP BY segment)"""


def _risk(spark, folder):
    clients = fact(spark, folder, "segment", "client_id", "spend").groupBy("segment", "client_id").agg(
        F.sum("spend").alias("c"))
    held = clients.groupBy("segment").agg(
        (F.max("c").cast("double") / F.sum("c").cast("double")).alias("concentration"))
    dense = trend.densify(segment_panel(spark, folder), ["segment"])
    return settle(trend.trend_features(dense, ["segment"]).join(held, "segment"))


@query("P15_risk_quadrant", sql(f"""
SELECT segment, {r('slope', 2)} AS slope, {r('held', 6)} AS concentration,
  CASE WHEN held >= med AND slope < 0 THEN 'High risk' WHEN held >= med THEN 'Star'
    WHEN slope < 0 THEN 'Monitor' ELSE 'Stable' END AS risk_class
FROM trend JOIN {_RISK} USING (segment) CROSS JOIN (SELECT median(held) AS med FROM {_RISK})""", "trend", "fact"))
def risk(spark, folder):
    return trend.risk_quadrant(_risk(spark, folder)).select(
        "segment", rounded(F.col("slope"), 2).alias("slope"),
        rounded(F.col("concentration"), 6).alias("concentration"), "risk_class")


@query("P16_worth_a_note", sql(f"""
SELECT segment FROM trend JOIN {_RISK} USING (segment)
WHERE abs(slope) > (SELECT quantile_cont(abs(slope), 0.65) FROM trend)
   OR held > (SELECT quantile_cont(held, 0.8) FROM {_RISK})""", "trend", "fact"))
def note(spark, folder):
    return trend.worth_a_note(_risk(spark, folder)).select("segment")


@query("P17_event_severity", sql("""
SELECT state, year_month, event_score, CASE WHEN event_score >= 60 THEN 'high'
  WHEN event_score >= 25 THEN 'medium' ELSE 'low' END AS severity FROM ev_score""", "ev_score"))
def severity(spark, folder):
    return ev.event_scores(star.event_calendar(spark, folder)).withColumn("severity", ev.severity())


@query("P18_label_fallback", sql(f"""
SELECT f.segment, coalesce(l.label, f.segment) AS label, {r('sum(spend)')} AS spend
FROM fact f LEFT JOIN labels l USING (segment) GROUP BY ALL""", "fact", "labels"))
def label_fallback(spark, folder):
    totals = fact(spark, folder, "segment", "spend").groupBy("segment").agg(
        rounded(F.sum("spend"), 4).alias("spend"))
    return clean.with_label(totals, star.segment_labels(spark, folder)).select("segment", "label", "spend")


# Joins --------------------------------------------------------------------------------

@query("J01_state_reference_join", sql(f"""
SELECT s.state, {r('total_spend', 2)} AS total_spend, transactions, population_m, gdp_b, tourism_b, hotel_count
FROM state_tot s LEFT JOIN ref USING (state)""", "state_tot", "ref"))
def reference_join(spark, folder):
    df = state_totals(spark, folder).join(star.state_reference(spark, folder), "state", "left")
    return df.select("state", rounded(F.col("total_spend"), 2).alias("total_spend"), "transactions",
                     "population_m", "gdp_b", "tourism_b", "hotel_count")


@query("J02_aligned_ratio", sql(f"""
SELECT segment, count(*) FILTER (ecomm_status = 'ACTIVE') AS active_lines, count(*) AS lines,
  {r("count(*) FILTER (ecomm_status = 'ACTIVE') / CAST(count(*) AS DOUBLE)", 6)} AS ratio
FROM fact GROUP BY ALL""", "fact"))
def aligned_ratio(spark, folder):
    df = fact(spark, folder, "segment", "ecomm_status")
    out = df.groupBy("segment").agg(
        F.count_if(F.col("ecomm_status") == "ACTIVE").alias("active_lines"), F.count("*").alias("lines"))
    return out.withColumn("ratio", rounded(ratio_or_zero(F.col("active_lines"), F.col("lines")), 6))


@query("J03_lookup_with_default", sql("""
SELECT s.state, coalesce(r.population_m, 5.0) AS population_m, coalesce(r.gdp_b, 300.0) AS gdp_b,
  coalesce(r.tourism_b, 10.0) AS tourism_b, coalesce(r.hotel_rooms_k, 80.0) AS hotel_rooms_k
FROM (SELECT DISTINCT state FROM fact) s
LEFT JOIN (SELECT * FROM ref WHERE state NOT IN ('NATION_3', 'NATION_8')) r USING (state)""", "fact", "ref"))
def lookup_default(spark, folder):
    known = star.state_reference(spark, folder).filter(~F.col("state").isin("NATION_3", "NATION_8"))
    states = fact(spark, folder, "state").distinct()
    return clean.with_defaults(states, known, ["state"], DEFAULT_REFERENCE)


@query("J04_prior_year", sql(f"""
SELECT a.state, a.year_month, {r('a.spend')} AS spend, {r('b.spend')} AS prior_year
FROM state_month a LEFT JOIN state_month b ON b.state = a.state AND b.year_month = a.year_month - 100
""", "state_month"))
def prior_year(spark, folder):
    return ev.prior_year(state_panel(spark, folder), ["state"]).select(
        "state", "year_month", rounded(F.col("spend"), 4).alias("spend"),
        rounded(F.col("prior_year"), 4).alias("prior_year"))


@query("J05_latest_known_months", sql(f"""
SELECT segment, state, year_month, {r('lag(spend, 1) OVER w')} AS known_1,
  {r('lag(spend, 2) OVER w')} AS known_2, {r('lag(spend, 3) OVER w')} AS known_3
FROM (SELECT segment, state, year_month, sum(spend) AS spend FROM fact GROUP BY ALL)
WINDOW w AS (PARTITION BY segment, state ORDER BY year_month)""", "fact"))
def latest_known(spark, folder):
    df = marts.segment_state_month(fact(spark, folder, "segment", "state", "year_month", "spend"))
    w = W.partitionBy("segment", "state").orderBy("year_month")
    return df.select("segment", "state", "year_month", *[
        rounded(F.lag("spend", k).over(w), 4).alias(f"known_{k}") for k in (1, 2, 3)])


_ALIGN = """FROM (SELECT DISTINCT segment FROM mix) s CROSS JOIN (SELECT DISTINCT cat_l1 FROM natmix) c
  LEFT JOIN mix m ON m.segment = s.segment AND m.cat_l1 = c.cat_l1 LEFT JOIN natmix n ON n.cat_l1 = c.cat_l1"""


def _aligned(spark, folder):
    df = mix_cells(spark, folder)
    return mix.mix_against_national(mix.category_mix(df), mix.national_mix(df))


@query("J06_mix_alignment", sql(f"""
SELECT s.segment, c.cat_l1, {r('coalesce(m.pct, 0)', 6)} AS segment_pct, {r('coalesce(n.pct, 0)', 6)} AS national_pct
{_ALIGN}""", "mix", "natmix"))
def mix_alignment(spark, folder):
    return _aligned(spark, folder).select(
        "segment", "cat_l1", rounded(F.col("segment_pct"), 6).alias("segment_pct"),
        rounded(F.col("national_pct"), 6).alias("national_pct"))


@query("J07_actual_else_forecast", sql(f"""
SELECT state, year_month, {r('coalesce(a.spend, f.spend, 0)')} AS spend,
  CASE WHEN a.spend IS NULL THEN 1 ELSE 0 END AS is_forecast
FROM (SELECT state, year_month, spend FROM state_month WHERE year_month <= {CUTOFF}) a
FULL JOIN (SELECT state, year_month + 100 AS year_month, spend FROM state_month
           WHERE year_month BETWEEN 200001 AND 200006) f USING (state, year_month)""", "state_month"))
def actual_forecast(spark, folder):
    """Last year's months stand in for the forecast of the horizon."""
    panel = state_panel(spark, folder)
    actual = panel.filter(F.col("year_month") <= CUTOFF)
    ahead = panel.filter(F.col("year_month").between(200001, 200006)).withColumn(
        "year_month", F.col("year_month") + 100)
    return growth.actual_or_forecast(actual, ahead, ["state"]).select(
        "state", "year_month", rounded(F.col("spend"), 4).alias("spend"), "is_forecast")


def _leaders(df):
    """The 15 brands of most spend, and of most lines: two methods' leading features."""
    whole = settle(df.groupBy(F.col("cat_l2").alias("feature")).agg(
        F.sum("spend").alias("spend"), F.count("*").alias("lines")))
    return [top_rows(whole.select("feature", F.col(by).alias("v")), 15, "v", "feature") for by in ("spend", "lines")]


@query("J08_importance_alignment", sql(f"""
SELECT coalesce(a.feature, b.feature) AS feature, {r('coalesce(a.v, 0)')} AS by_spend, {r('coalesce(b.v, 0)')} AS by_lines
FROM (SELECT cat_l2 AS feature, sum(spend) AS v FROM fact GROUP BY ALL ORDER BY v DESC, feature LIMIT 15) a
FULL JOIN (SELECT cat_l2 AS feature, count(*) AS v FROM fact GROUP BY ALL ORDER BY v DESC, feature LIMIT 15) b
  ON a.feature = b.feature""", "fact"))
def importance_alignment(spark, folder):
    spend, lines = _leaders(fact(spark, folder, "cat_l2", "spend"))
    return align_importances({
        "by_spend": spend.select("feature", rounded(F.col("v"), 4).alias("importance")),
        "by_lines": lines.select("feature", F.col("v").cast("double").alias("importance"))})


@query("J09_listed_rows_in_order", sql(f"""
SELECT t.place, f.state, {", ".join(r(f"coalesce(sum(f.spend) FILTER (f.cat_l1 = '{c}'), 0)") + f" AS {c.lower()}" for c in CATEGORIES)}
FROM fact f JOIN (SELECT state, row_number() OVER (ORDER BY total_spend DESC, state) AS place FROM state_tot) t
  ON t.state = f.state AND t.place <= 10 GROUP BY ALL""", "fact", "state_tot"))
def listed_rows(spark, folder):
    df = fact(spark, folder, "state", "cat_l1", "spend")
    top = top_rows(rollup.key_stats(df, "state"), 10, "total_spend", "state")
    placed = top.select("state", F.row_number().over(W.orderBy(F.desc("total_spend"), "state")).alias("place"))
    wide = rollup.pivot_sum(df, ["state"], "cat_l1", CATEGORIES)
    return wide.join(placed, "state").select(
        "place", "state", *[rounded(F.col(c), 4).alias(c.lower()) for c in CATEGORIES])


# Set operations and reshaping ------------------------------------------------------------

@query("U01_append_rows", sql(f"""
SELECT segment, {r('sum(spend)')} AS spend FROM fact GROUP BY segment
UNION ALL SELECT 'All', {r('sum(spend)')} FROM fact""", "fact"))
def append_rows(spark, folder):
    totals = fact(spark, folder, "segment", "spend").groupBy("segment").agg(F.sum("spend").alias("spend"))
    whole = totals.agg(F.sum("spend").alias("spend")).withColumn("segment", F.lit("All"))
    return totals.unionByName(whole).select("segment", rounded(F.col("spend"), 4).alias("spend"))


@query("U02_set_union", sql("""
SELECT feature FROM (SELECT cat_l2 AS feature, sum(spend) AS v FROM fact GROUP BY ALL ORDER BY v DESC, feature LIMIT 15)
UNION SELECT feature FROM (SELECT cat_l2 AS feature, count(*) AS v FROM fact GROUP BY ALL ORDER BY v DESC, feature LIMIT 15)""", "fact"))
def set_union(spark, folder):
    spend, lines = _leaders(fact(spark, folder, "cat_l2", "spend"))
    return spend.select("feature").union(lines.select("feature")).distinct()


@query("U03_densify", sql(f"""
SELECT s.segment, s.state, m.year_month, {r('coalesce(f.spend, 0)')} AS spend
FROM (SELECT DISTINCT segment, state FROM fact) s CROSS JOIN (SELECT DISTINCT year_month FROM fact) m
LEFT JOIN (SELECT segment, state, year_month, sum(spend) AS spend FROM fact GROUP BY ALL) f
  USING (segment, state, year_month)""", "fact"))
def densify(spark, folder):
    df = settle(marts.segment_state_month(fact(spark, folder, "segment", "state", "year_month", "spend")))
    return trend.densify(df, ["segment", "state"]).select(
        "segment", "state", "year_month", rounded(F.col("spend"), 4).alias("spend"))


@query("U04_wide_and_long", sql(f"""
SELECT segment, status, {r('coalesce(sum(spend), 0)')} AS spend
FROM (SELECT DISTINCT segment FROM fact) CROSS JOIN (SELECT unnest(['ACTIVE', 'INACTIVE', 'PENDING']) AS status)
LEFT JOIN (SELECT segment AS s, ecomm_status AS e, spend FROM fact) ON s = segment AND e = status GROUP BY ALL
""", "fact"))
def wide_long(spark, folder):
    names = ["ACTIVE", "INACTIVE", "PENDING"]
    wide = rollup.pivot_sum(fact(spark, folder, "segment", "ecomm_status", "spend"), ["segment"], "ecomm_status", names)
    return wide.unpivot(["segment"], names, "status", "spend").withColumn("spend", rounded(F.col("spend"), 4))


@query("U05_distinct_keys", sql("SELECT DISTINCT segment, state FROM fact", "fact"))
def distinct_keys(spark, folder):
    return fact(spark, folder, "segment", "state").distinct().orderBy("segment", "state")


# Scalar functions ---------------------------------------------------------------------

@query("F01_log1p_expm1", sql(f"""
SELECT customer_id, {r('ln(1 + CAST(total_spend AS DOUBLE))', 8)} AS logged,
  {r('exp(ln(1 + CAST(total_spend AS DOUBLE)) / 2) - 1')} AS half FROM customers""", "customers"))
def logs(spark, folder):
    x = F.col("total_spend").cast("double")
    return customer_spend(spark, folder).select(
        "customer_id", rounded(F.log1p(x), 8).alias("logged"), rounded(F.expm1(F.log1p(x) / 2), 4).alias("half"))


@query("F02_month_encoding", sql(f"""
SELECT year_month, {r('sin(2 * pi() * (year_month % 100) / 12)', 8)} AS month_sin,
  {r('cos(2 * pi() * (year_month % 100) / 12)', 8)} AS month_cos FROM month_total""", "month_total"))
def encoding(spark, folder):
    return month_total(spark, folder).select(
        "year_month", rounded(season_sin("year_month"), 8).alias("month_sin"),
        rounded(season_cos("year_month"), 8).alias("month_cos"))


@query("F03_month_parts", sql("""
SELECT year_month, CAST(year_month % 100 AS INTEGER) AS month, CAST(year_month // 100 AS INTEGER) AS year,
  strftime(make_date(year_month // 100, year_month % 100, 1), '%Y %b') AS label,
  CAST(strftime(make_date(year_month // 100, year_month % 100, 1) + INTERVAL 5 MONTH, '%Y%m') AS INTEGER) AS in_5_months,
  year_month AS parsed FROM month_total""", "month_total"))
def month_parts(spark, folder):
    text = F.concat_ws("-", F.substring(F.col("year_month").cast("string"), 1, 4),
                       F.substring(F.col("year_month").cast("string"), 5, 2))
    return month_total(spark, folder).select(
        "year_month", month_of("year_month").alias("month"), year_of("year_month").alias("year"),
        month_label("year_month").alias("label"), add_months("year_month", 5).alias("in_5_months"),
        parse_year_month(text).alias("parsed"))


@query("F04_clamp", sql(f"""
SELECT customer_id, {r('greatest(lo, least(hi, x))')} AS bounded
FROM (SELECT customer_id, CAST(total_spend AS DOUBLE) AS x, 500000.0 + CAST(customer_id AS INTEGER) * 1000 AS lo,
  1200000.0 AS hi FROM customers)""", "customers"))
def clamped(spark, folder):
    low = F.lit(500_000.0) + F.col("customer_id").cast("int") * 1000
    return customer_spend(spark, folder).select("customer_id", rounded(
        clamp(F.col("total_spend").cast("double"), low, F.lit(1_200_000.0)), 4).alias("bounded"))


@query("F05_unit_scale", sql(f"""
SELECT state, {r('(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())', 8)} AS scaled
FROM (SELECT state, CAST(total_spend AS DOUBLE) AS x FROM state_tot)""", "state_tot"))
def scaled(spark, folder):
    df = unit_scale(settle(state_totals(spark, folder)), ["total_spend"])
    return df.select("state", rounded(F.col("total_spend_scaled"), 8).alias("scaled"))


@query("F06_standard_score", sql(f"""
SELECT state, {r('(x - avg(x) OVER ()) / (stddev_pop(x) OVER () + 1e-9)')} AS z
FROM (SELECT state, CAST(total_spend AS DOUBLE) AS x FROM state_tot)""", "state_tot"))
def z_score(spark, folder):
    df = standard_score(settle(state_totals(spark, folder)), ["total_spend"])
    return df.select("state", rounded(F.col("total_spend_z"), 4).alias("z"))


@query("F07_abs_sqrt_clip", sql(f"""
SELECT state, year_month, {r('abs(d)')} AS size, {r('sqrt(greatest(CAST(spend AS DOUBLE), 1e6) / 1e6)', 6)} AS bubble
FROM (SELECT *, coalesce(CAST(spend - lag(spend) OVER (PARTITION BY state ORDER BY year_month) AS DOUBLE), 0) AS d
  FROM state_month)""", "state_month"))
def abs_sqrt(spark, folder):
    df = trend.step_delta(state_month(spark, folder), "year_month", "spend", ["state"])
    bubble = F.sqrt(F.greatest(F.col("spend").cast("double"), F.lit(1e6)) / 1e6)
    return df.select("state", "year_month", rounded(F.abs("delta"), 4).alias("size"),
                     rounded(bubble, 6).alias("bubble"))


@query("F08_text", """
SELECT p_partkey AS part, lower(p_type) AS low, replace(p_brand, '#', ' ') AS swapped, left(p_name, 6) AS cut,
  concat_ws('; ', p_type, p_brand) AS joined,
  CASE p_size % 2 WHEN 0 THEN 'Room Count' ELSE 'Cat L1' END AS label FROM part""")
def text(spark, folder):
    name = F.when(F.col("p_size") % 2 == 0, "room_count").otherwise("cat_l1_enc")
    return star.table(spark, folder, "part").select(
        F.col("p_partkey").alias("part"), F.lower("p_type").alias("low"),
        F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("swapped"),
        F.left("p_name", F.lit(6)).alias("cut"), F.concat_ws("; ", "p_type", "p_brand").alias("joined"),
        clean_label(name).alias("label"))


@query("F09_list_length", """
SELECT p_partkey AS part, CAST(2 + CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM part""")
def list_length(spark, folder):
    parts = F.array_compact(F.array("p_type", "p_brand", F.when(F.col("p_size") > 25, "big")))
    return star.table(spark, folder, "part").select(
        F.col("p_partkey").alias("part"), F.size(parts).cast("long").alias("n"))


@query("F10_money_text", sql("""
SELECT state, year_month, CASE WHEN x >= 1e9 THEN printf('$%.2fB', x / 1e9) WHEN x >= 1e6 THEN printf('$%.2fM', x / 1e6)
  WHEN x >= 1e3 THEN printf('$%.1fK', x / 1e3) ELSE printf('$%.0f', x) END AS text
FROM (SELECT state, year_month, CAST(spend AS DOUBLE) AS x FROM state_month)""", "state_month"))
def money_text(spark, folder):
    return state_month(spark, folder).select("state", "year_month", money("spend").alias("text"))


@query("F11_safe_ratio", sql(f"""
SELECT state, {r('coalesce(p / nullif(CAST(q AS DOUBLE), 0), 0)', 6)} AS ratio
FROM (SELECT state, p, CASE WHEN state < 'NATION_2' THEN 0 ELSE n END AS q
  FROM (SELECT state, count(*) FILTER (cat_l1 = 'PROMO') AS p, count(*) AS n FROM fact GROUP BY ALL))""", "fact"))
def safe_ratio(spark, folder):
    df = fact(spark, folder, "state", "cat_l1").groupBy("state").agg(
        F.count_if(F.col("cat_l1") == "PROMO").alias("p"), F.count("*").alias("n"))
    bottom = F.when(F.col("state") < "NATION_2", F.lit(0)).otherwise(F.col("n"))
    return df.select("state", rounded(ratio_or_zero(F.col("p"), bottom), 6).alias("ratio"))
