"""Statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators.clean import category_depth
from ..operators import information, mix, ranking, stats, trend
from ..session import settle
from ..sources import star
from .base import fact, least_squares_sql, mix_cells, query, r, segment_panel, sql, state_totals

FACTORS = ["population_m", "gdp_b", "tourism_b", "hotel_count", "hotel_rooms_k", "event_count"]


@query("Q01_trend_features", sql(f"""
SELECT segment, n, {r('slope', 2)} AS slope, {r('slope_norm', 6)} AS slope_norm, {r('r2', 6)} AS r2,
  {r('momentum', 6)} AS momentum, {r('volatility', 6)} AS volatility, {r('q1_avg', 2)} AS q1_avg,
  {r('q4_avg', 2)} AS q4_avg, best_month, worst_month FROM trend""", "trend"))
def trend_features(spark, folder):
    dense = trend.densify(segment_panel(spark, folder), ["segment"])
    df = trend.trend_features(dense, ["segment"])
    return df.select("segment", "n", *[rounded(F.col(c), 2).alias(c) for c in ("slope", "q1_avg", "q4_avg")],
                     *[rounded(F.col(c), 6).alias(c) for c in ("slope_norm", "r2", "momentum", "volatility")],
                     "best_month", "worst_month")


_STATES = "(SELECT s.state, CAST(total_spend AS DOUBLE) AS y, ref.* EXCLUDE (state) FROM state_tot s JOIN ref USING (state))"


def _states(spark, folder):
    return settle(state_totals(spark, folder).join(star.state_reference(spark, folder), "state"))


@query("Q02_factor_correlation", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS factor, {r(f'regr_sxy(y, x) / sqrt(regr_sxx(y, x) * regr_syy(y, x))', 6)} AS pearson_r, "
    f"{r('pow(regr_sxy(y, x), 2) / (regr_sxx(y, x) * regr_syy(y, x))', 6)} AS r_squared "
    f"FROM (SELECT y, coalesce({c}, 0) AS x FROM {_STATES})" for c in FACTORS), "state_tot", "ref"))
def correlation(spark, folder):
    df = stats.factor_correlation(_states(spark, folder), FACTORS)
    return df.select("factor", rounded(F.col("pearson_r"), 6).alias("pearson_r"),
                     rounded(F.col("r_squared"), 6).alias("r_squared"))


# Student's distribution at whole degrees of freedom v = n - 2 is a finite sum over powers of the cosine of atan(t / sqrt(v)).
_P_VALUES = "(" + f"""
SELECT factor, 1 - CASE WHEN v % 2 = 1 THEN 2 / pi() * (a + sin(a) * coalesce(sum(odd * pow(cos(a), 2 * k + 1)), 0))
    ELSE sin(a) * sum(even * pow(cos(a), 2 * k)) END AS p
FROM (SELECT factor, n - 2 AS v, atan(abs(x) / sqrt(1 - x * x)) AS a FROM ({' UNION ALL '.join(
    f"SELECT '{c}' AS factor, corr(y, coalesce({c}, 0)) AS x, count(*) AS n FROM {_STATES}" for c in FACTORS)}))
LEFT JOIN (SELECT k, exp(coalesce(sum(ln(2 * k / (2 * k + 1.0))) FILTER (k > 0) OVER (ORDER BY k), 0)) AS odd,
    exp(coalesce(sum(ln((2 * k - 1) / (2.0 * k))) FILTER (k > 0) OVER (ORDER BY k), 0)) AS even
  FROM (SELECT unnest(range((SELECT count(*) FROM state_tot))) AS k)) ON k <= (v - 2 - v % 2) // 2
GROUP BY factor, v, a""" + ")"


@query("Q02_factor_significance", sql(f"""
SELECT factor, {r('p', 6)} AS p_value, p < 0.05 AS significant FROM {_P_VALUES}""", "state_tot", "ref"))
def significance(spark, folder):
    """r with p-values, over all states."""
    df = stats.factor_correlation(_states(spark, folder), FACTORS)
    return df.select("factor", rounded(F.col("p_value"), 6).alias("p_value"), "significant").orderBy("factor")


@query("Q02_significant_factors", sql(f"""
SELECT factor, CAST(p < 0.05 AS INTEGER) AS significant FROM {_P_VALUES}""", "state_tot", "ref"))
def significant_factors(spark, folder):
    """Which factors pass the 5 % level, by their p-values."""
    df = stats.factor_correlation(_states(spark, folder), FACTORS)
    return df.select("factor", F.col("significant").cast("int").alias("significant"))


@query("Q02_top_states_correlation", sql(" UNION ALL ".join(f"""
SELECT '{c}' AS factor, {r(f'corr(y, coalesce({c}, 0))', 6)} AS pearson_r
FROM (SELECT * FROM {_STATES} ORDER BY y DESC, state LIMIT 30)""" for c in ("gdp_b", "tourism_b")), "state_tot", "ref"))
def top_states(spark, folder):
    """The 30 states of most spend, as the report shows them."""
    top = ranking.top_rows(_states(spark, folder), 30, "total_spend", "state")
    return stats.factor_correlation(top, ["gdp_b", "tourism_b"]).select("factor", rounded(F.col("pearson_r"), 6).alias("pearson_r"))


_INPUTS = [c for c in FACTORS if c != "hotel_count"]
_PLANE = least_squares_sql(f"SELECT [{', '.join(f'coalesce({c}, 0)' for c in _INPUTS)}] AS f, y FROM {_STATES}", len(_INPUTS), guard=" + 1e-9")


@query("Q03_standardised_regression", sql(f"""
SELECT {_INPUTS!r}[i] AS factor, {r('b', 2)} AS coefficient FROM {_PLANE}
UNION ALL SELECT 'intercept', {r('avg(y)', 2)} FROM {_STATES}""", "state_tot", "ref"))
def regression(spark, folder):
    df = stats.standardised_regression(_states(spark, folder), _INPUTS)
    return df.withColumn("coefficient", rounded(F.col("coefficient"), 2))


@query("Q04_fit_line", sql(f"""
SELECT segment, {r('regr_slope(x, m)', 2)} AS slope, {r('regr_intercept(x, m)', 2)} AS intercept
FROM (SELECT segment, CAST(spend AS DOUBLE) AS x, month_no AS m FROM dense) GROUP BY ALL""", "dense"))
def fit_line(spark, folder):
    dense = trend.densify(segment_panel(spark, folder), ["segment"])
    df = stats.fit_line(dense, "month_no", "spend", ["segment"])
    return df.select("segment", rounded(F.col("slope"), 2).alias("slope"),
                     rounded(F.col("intercept"), 2).alias("intercept"))


@query("Q05_over_and_under_index", sql(f"""
SELECT s.segment, c.cat_l1, {r('coalesce(m.pct, 0) - coalesce(n.pct, 0)', 6)} AS delta_pp
FROM (SELECT DISTINCT segment FROM mix) s CROSS JOIN (SELECT DISTINCT cat_l1 FROM natmix) c
LEFT JOIN mix m ON m.segment = s.segment AND m.cat_l1 = c.cat_l1 LEFT JOIN natmix n ON n.cat_l1 = c.cat_l1
""", "mix", "natmix"))
def over_index(spark, folder):
    df = mix_cells(spark, folder)
    out = mix.mix_against_national(mix.category_mix(df), mix.national_mix(df))
    return out.select("segment", "cat_l1", rounded(F.col("delta_pp"), 6).alias("delta_pp")).orderBy("segment", "delta_pp")


@query("Q06_category_mix", sql(f"""
SELECT segment, cat_l1, {r('total_spend')} AS total_spend, {r('pct', 6)} AS pct FROM mix
UNION ALL SELECT 'National', cat_l1, {r('total_spend')}, {r('pct', 6)} FROM natmix""", "mix", "natmix"))
def category_mix(spark, folder):
    df = mix_cells(spark, folder)
    whole = mix.national_mix(df).withColumn("segment", F.lit("National"))
    return mix.category_mix(df).unionByName(whole).select(
        "segment", "cat_l1", rounded(F.col("total_spend"), 4).alias("total_spend"), rounded(F.col("pct"), 6).alias("pct"))


@query("Q07_top_three_share", sql(f"""
SELECT {r('CAST(sum(total_spend) FILTER (rn <= 3) * 100 AS DOUBLE) / CAST(sum(total_spend) AS DOUBLE)', 6)} AS top_3_share_pct
FROM (SELECT *, row_number() OVER (ORDER BY total_spend DESC, state) AS rn FROM state_tot)""", "state_tot"))
def top_three(spark, folder):
    totals = settle(state_totals(spark, folder))
    whole = totals.select(F.sum("total_spend")).scalar()
    best = ranking.top_rows(totals, 3, "total_spend", "state").agg(F.sum("total_spend").alias("s"))
    share = (F.col("s") * 100).cast("double") / whole.cast("double")
    return best.select(rounded(share, 6).alias("top_3_share_pct"))


_MI_FEATURES = ["segment", "cat_l1", "cat_l2", "cat_l3", "cat_l4", "state", "ecomm_status", "entity_type",
                "distributor_group", "has_rooms", "room_band", "category_depth", "month"]
_EDGES = ", ".join(f"quantile_cont(CAST(spend AS DOUBLE), {i / 10})" for i in range(1, 10))
_BINS = " + ".join(f"(e[{i}] < y)::INT" for i in range(1, 10))


@query("Q08_mutual_information", sql(f"""
SELECT feature, {r('sum(n / CAST(total AS DOUBLE) * ln(n * CAST(total AS DOUBLE) / (nx * CAST(ny AS DOUBLE))))', 6)} AS mutual_information
FROM (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, b) AS ny,
    sum(n) OVER (PARTITION BY feature) AS total
  FROM (SELECT feature, x, b, count(*) AS n FROM (
      SELECT unnest({_MI_FEATURES!r}) AS feature,
        unnest([segment, cat_l1, cat_l2, cat_l3, coalesce(cat_l4, '?'), state, ecomm_status, entity_type,
          distributor_group, CAST(CAST(rooms IS NOT NULL AS INTEGER) AS VARCHAR),
          CAST(CAST(coalesce(rooms, 0) AS INTEGER) // 100 AS VARCHAR),
          CAST(3 + CAST(cat_l4 IS NOT NULL AS INTEGER) AS VARCHAR), CAST(year_month % 100 AS VARCHAR)]) AS x, b
      FROM (SELECT *, {_BINS} AS b FROM (SELECT *, CAST(spend AS DOUBLE) AS y FROM fact), (SELECT [{_EDGES}] AS e FROM fact)))
    GROUP BY ALL)) GROUP BY ALL""", "fact"))
def mutual_information(spark, folder):
    return stats.mutual_information(_features_of(spark, folder), _MI_FEATURES, "spend").select(
        "feature", rounded(F.col("mutual_information"), 6).alias("mutual_information"))


def _features_of(spark, folder):
    return fact(spark, folder, *_MI_FEATURES[:9], "rooms", "year_month", "spend").withColumns({
        "has_rooms": F.col("rooms").isNotNull().cast("int").cast("string"),
        "room_band": F.floor(F.coalesce("rooms", F.lit(0)) / 100).cast("string"),
        "category_depth": category_depth().cast("string"), "month": (F.col("year_month") % 100).cast("string")})


_K = information.NEIGHBOURS
_AROUND = ", ".join(f"greatest(y - lag(y, {j}) OVER o, lead(y, {_K - j}) OVER o - y) + CASE WHEN lag(y, {j}) OVER o IS NULL "
                    f"OR lead(y, {_K - j}) OVER o IS NULL THEN NULL ELSE 0 END" for j in range(_K + 1))


@query("Q08_knn_mutual_information", sql(f"""
SELECT feature, {r("greatest(0, ps.h + avg(pk.h) - avg(px.h) - avg(pm.h))", 6)} AS mutual_information
FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS total, count(*) OVER (
    PARTITION BY feature ORDER BY y RANGE BETWEEN d PRECEDING AND d FOLLOWING) AS m
  FROM (SELECT *, greatest(CASE WHEN n > {_K} THEN near ELSE greatest(y - low, high - y) END, 1) - 1 AS d, least(n - 1, {_K}) AS kk
    FROM (SELECT *, least({_AROUND}) AS near, count(*) OVER v AS n, min(y) OVER v AS low, max(y) OVER v AS high
      FROM (SELECT CAST(round(ln(1 + CAST(spend AS DOUBLE)) / {information.GRID}) AS BIGINT) AS y, unnest({_MI_FEATURES!r}) AS feature,
        unnest([segment, cat_l1, cat_l2, cat_l3, coalesce(cat_l4, '?'), state, ecomm_status, entity_type,
          distributor_group, CAST(CAST(rooms IS NOT NULL AS INTEGER) AS VARCHAR),
          CAST(CAST(coalesce(rooms, 0) AS INTEGER) // 100 AS VARCHAR),
          CAST(3 + CAST(cat_l4 IS NOT NULL AS INTEGER) AS VARCHAR), CAST(year_month % 100 AS VARCHAR)]) AS x FROM fact)
      WINDOW o AS (PARTITION BY feature, x ORDER BY y), v AS (PARTITION BY feature, x)) WHERE n > 1)) q
  JOIN psi ps ON ps.n = total JOIN psi pk ON pk.n = kk JOIN psi px ON px.n = q.n JOIN psi pm ON pm.n = m
GROUP BY feature, ps.h""", "fact", "psi"))
def knn_mutual_information(spark, folder):
    return information.knn_mutual_information(_features_of(spark, folder), _MI_FEATURES, F.log1p(F.col("spend").cast("double"))).select(
        "feature", rounded(F.col("mutual_information"), 6).alias("mutual_information"))


@query("Q09_basket_similarity", sql(f"""
SELECT b.customer_id, {r('coalesce(max(inter / CAST(na + nc - inter AS DOUBLE)), 0)', 6)} AS jaccard
FROM (SELECT customer_id, count(DISTINCT cat_l2) AS na FROM fact GROUP BY ALL) b
LEFT JOIN (SELECT customer_id, centroid, nc, count(*) AS inter
  FROM (SELECT DISTINCT customer_id, cat_l2 FROM fact) JOIN (
    SELECT *, count(*) OVER (PARTITION BY centroid) AS nc FROM (
      SELECT segment AS centroid, cat_l2 FROM fact JOIN (SELECT segment AS sg, count(DISTINCT customer_id) AS keys FROM fact GROUP BY ALL)
        ON sg = segment GROUP BY segment, cat_l2, keys HAVING count(DISTINCT customer_id) >= keys * 0.5)) USING (cat_l2)
  GROUP BY ALL) s USING (customer_id) GROUP BY ALL""", "fact"))
def basket(spark, folder):
    df = stats.basket_similarity(fact(spark, folder, "customer_id", "segment", "cat_l2"))
    return df.withColumn("jaccard", rounded(F.col("jaccard"), 6))
