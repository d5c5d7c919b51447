"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..models import anomaly, cluster
from ..models.regress import PURCHASE_FEATURES, purchase_features
from ..operators import clean, growth, mix, ranking, rollup, stats, trend
from ..operators.ranking import top_rows
from ..plans import marts
from ..session import settle
from .base import (
    CATEGORIES, CUTOFF, QUARTERS, STATES, customer_profiles, customer_spend, detail, fact, full_segment_month,
    month_total, query, r, segment_month, segment_panel, sql, state_panel,
)

_PRICES = f"{r('sum(spend)')} AS spend, {r('sum(list_price)')} AS list_price, {r('sum(savings)')} AS savings"


def _money(df, *names):
    return df.withColumns({name: rounded(F.col(name), 4) for name in names})


@query("A00_customer_month", sql(f"""
SELECT segment, client_id, customer_id, state, cat_l1, year_month, {r('spend')} AS spend,
  {r('list_price')} AS list_price, {r('savings')} AS savings FROM detail""", "detail"))
def customer_month(spark, folder):
    return _money(detail(spark, folder), "spend", "list_price", "savings")


@query("A01_portfolio_month", sql(f"""
SELECT year_month, {_PRICES}, count(DISTINCT customer_id) AS locations, count(DISTINCT client_id) AS clients,
  count(DISTINCT cat_l1) AS categories FROM fact GROUP BY ALL""", "fact"))
def portfolio_month(spark, folder):
    return _money(marts.portfolio_month(detail(spark, folder)), *marts.PRICES)


@query("A02_segment_month", sql(f"""
SELECT segment, year_month, {_PRICES}, count(DISTINCT customer_id) AS locations,
  count(DISTINCT client_id) AS clients, count(DISTINCT cat_l1) AS categories FROM fact GROUP BY ALL""", "fact"))
def seg_month(spark, folder):
    return _money(full_segment_month(spark, folder), *marts.PRICES)


@query("A03_category_month", sql(f"""
SELECT cat_l1, year_month, {_PRICES}, count(DISTINCT customer_id) AS locations,
  count(DISTINCT segment) AS segments FROM fact GROUP BY ALL""", "fact"))
def cat_month(spark, folder):
    return _money(marts.category_month(detail(spark, folder)), *marts.PRICES)


@query("A04_state_month", sql(f"""
SELECT state, year_month, {r('sum(spend)')} AS spend, count(DISTINCT customer_id) AS locations,
  count(DISTINCT client_id) AS clients FROM fact
WHERE state IN ({', '.join(f"'{s}'" for s in STATES)}) GROUP BY ALL""", "fact"))
def st_month(spark, folder):
    return _money(marts.state_month(detail(spark, folder), STATES), "spend")


@query("A05_two_levels", sql(f"""
SELECT segment, CASE WHEN grouping(state) = 1 THEN 'All States' ELSE state END AS state, year_month,
  {r('sum(spend)')} AS spend FROM fact
GROUP BY GROUPING SETS ((segment, state, year_month), (segment, year_month))""", "fact"))
def two_levels(spark, folder):
    df = fact(spark, folder, "segment", "state", "year_month", "spend")
    return _money(rollup.two_levels(df, ["segment", "state", "year_month"], ["segment", "year_month"],
                                    ["spend"], "All States", "state"), "spend")


_STATS = f"""{r('sum(spend)')} AS total_spend, {r('CAST(sum(spend) AS DOUBLE) / count(spend)', 2)} AS avg_spend,
  count(spend) AS transactions"""


@query("A06_key_stats", sql(" UNION ALL ".join(
    f"SELECT '{k}' AS dimension, {k} AS value, {_STATS} FROM fact WHERE {k} IS NOT NULL GROUP BY ALL"
    for k in ("segment", "cat_l1", "entity_type", "state")), "fact"))
def key_stats(spark, folder):
    """Four dimensions from one scan: the groupings are sets of one aggregation."""
    keys = ["segment", "cat_l1", "entity_type", "state"]
    df = fact(spark, folder, *keys, "spend")
    own = {k: F.grouping(k).alias(f"_{k}") for k in keys}  # 0 where the set groups by this key
    grouped = df.groupingSets([[k] for k in keys], *keys).agg(
        F.sum("spend").alias("total_spend"), F.avg("spend").alias("avg_spend"),
        F.count("spend").alias("transactions"), *own.values())
    name = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in keys])
    return grouped.withColumns({"dimension": name, "value": F.coalesce(*keys)}).where("value IS NOT NULL").select(
        "dimension", "value",
        rounded(F.col("total_spend"), 4).alias("total_spend"),
        rounded(F.col("avg_spend"), 2).alias("avg_spend"), "transactions")


@query("A07_ecomm_impact", sql(f"""
SELECT ecomm_status, {r('CAST(sum(spend) AS DOUBLE) / count(spend)', 2)} AS mean,
  {r('quantile_cont(CAST(spend AS DOUBLE), 0.5)')} AS median, count(spend) AS n, {r('sum(spend)')} AS spend
FROM fact GROUP BY ALL""", "fact"))
def ecomm_impact(spark, folder):
    df = fact(spark, folder, "ecomm_status", "spend")
    middle = ranking.quantiles(df, ["ecomm_status"], "spend", {"median": 0.5})
    return rollup.key_stats(df, "ecomm_status").join(middle, "ecomm_status").select(
        "ecomm_status", rounded(F.col("avg_spend"), 2).alias("mean"), rounded(F.col("median"), 4).alias("median"),
        F.col("transactions").alias("n"), rounded(F.col("total_spend"), 4).alias("spend"))


@query("A08_monthly_total", sql(f"SELECT year_month, {r('spend')} AS spend FROM month_total", "month_total"))
def monthly_total(spark, folder):
    return _money(month_total(spark, folder), "spend")


def _summary_sql(group: str) -> str:
    lead = f"{group}, " if group else ""
    x = "CAST(spend AS DOUBLE)"
    return f"""SELECT {lead}count(spend) AS n, {r(f'avg({x})', 2)} AS mean, {r(f'stddev_samp({x})', 2)} AS std,
  {r('min(spend)')} AS min, {r(f'quantile_cont({x}, 0.25)')} AS q25, {r(f'quantile_cont({x}, 0.5)')} AS q50,
  {r(f'quantile_cont({x}, 0.75)')} AS q75, {r('max(spend)')} AS max FROM fact {'GROUP BY ' + group if group else ''}"""


def _round_summary(df, *keys):
    return df.select(*keys, "n", rounded(F.col("mean"), 2).alias("mean"), rounded(F.col("std"), 2).alias("std"),
                     *[rounded(F.col(c), 4).alias(c) for c in ("min", "q25", "q50", "q75", "max")])


@query("A09_summary", sql(_summary_sql(""), "fact"))
def summary(spark, folder):
    return _round_summary(ranking.summary(fact(spark, folder, "spend"), []))


@query("A10_summary_by_anomaly")
def summary_by_anomaly(spark, folder):
    return _round_summary(ranking.summary(
        anomaly.flagged(purchase_features(fact(spark, folder)), PURCHASE_FEATURES), ["is_anomaly"]), "is_anomaly")


@query("A10_anomaly_totals", sql(f"""
SELECT count(*) AS n, {r('sum(spend)', 2)} AS spend, 1 AS share_holds, 0 AS out_of_range FROM fact WHERE spend > 0""", "fact"))
def anomaly_totals(spark, folder):
    """Flagged and other lines are all lines of positive spend; at most the contamination share is flagged."""
    df = anomaly.flagged(purchase_features(fact(spark, folder)), PURCHASE_FEATURES)
    share = F.avg(F.col("is_anomaly").cast("double"))
    return df.agg(F.count("*").alias("n"), rounded(F.sum("spend"), 2).alias("spend"), (share <= 0.02).cast("int").alias("share_holds"),
                  F.count_if(~F.col("anomaly_score").between(0, 1) | ~F.col("is_anomaly").isin(0, 1)).cast("int").alias("out_of_range"))


@query("A11_value_counts", sql("SELECT cat_l4, count(*) AS n FROM fact WHERE cat_l4 IS NOT NULL GROUP BY ALL", "fact"))
def counts(spark, folder):
    return rollup.value_counts(fact(spark, folder, "cat_l4"), "cat_l4").orderBy(F.desc("n"), "cat_l4")


@query("A12_customer_profile", sql(f"""
SELECT customer_id, {r('total_spend')} AS total_spend, {r('avg_spend', 2)} AS avg_spend, transactions,
  unique_categories, unique_distributors, has_rooms FROM profile""", "profile"))
def profile(spark, folder):
    df = customer_profiles(spark, folder)
    return df.withColumns({"total_spend": rounded(F.col("total_spend"), 4),
                           "avg_spend": rounded(F.col("avg_spend"), 2)})


@query("A13_cluster_profile")
def cluster_profile(spark, folder):
    ready = settle(cluster.cluster_frame(customer_profiles(spark, folder)))
    model = cluster.fit_kmeans(ready, 5)
    return cluster.cluster_profile(cluster.assign(ready, model), ["total_spend", *cluster.CLUSTER_FEATURES])


@query("A13_cluster_totals", sql(f"""
SELECT 5 AS clusters, count(*) AS customers, {r('sum(total_spend)', 2)} AS total_spend, sum(transactions)::BIGINT AS transactions
FROM profile""", "profile"))
def cluster_totals(spark, folder):
    """Sizes and means of the clusters add up to all customers."""
    found = cluster_profile(spark, folder)
    return found.agg(F.count_distinct("cluster").cast("int").alias("clusters"), F.sum("size").alias("customers"),
                     rounded(F.sum(F.col("size") * F.col("total_spend")), 2).alias("total_spend"),
                     F.round(F.sum(F.col("size") * F.col("transactions"))).cast("long").alias("transactions"))


@query("A13_profile_by_residue", sql(f"""
SELECT CAST(customer_id AS BIGINT) % 5 AS cluster, count(*) AS size, {r('avg(CAST(total_spend AS DOUBLE))', 2)} AS total_spend,
  {r('avg(transactions)', 6)} AS transactions, {r('avg(unique_categories)', 6)} AS unique_categories
FROM profile GROUP BY ALL""", "profile"))
def profile_by_residue(spark, folder):
    """The profile of given clusters, here by the customer's number."""
    df = customer_profiles(spark, folder)
    placed = df.withColumn("cluster", F.col("customer_id").cast("long") % 5)
    out = cluster.cluster_profile(placed, ["total_spend", "transactions", "unique_categories"])
    return out.select("cluster", "size", rounded(F.col("total_spend"), 2).alias("total_spend"),
                      *[rounded(F.col(c), 6).alias(c) for c in ("transactions", "unique_categories")])


_SEG = """(SELECT segment, sum(spend) AS total_spend, sum(list_price) AS total_list_price, sum(savings) AS total_savings,
  avg(locations) AS avg_locations, max(locations) AS max_locations, max(categories) AS category_breadth
  FROM seg_month GROUP BY ALL)"""


@query("A14_segment_totals", sql(f"""
SELECT segment, {r('total_spend')} AS total_spend, {r('avg_locations', 6)} AS avg_locations, max_locations,
  category_breadth FROM {_SEG}""", "seg_month"))
def segment_totals(spark, folder):
    return rollup.segment_totals(full_segment_month(spark, folder)).select(
        "segment", rounded(F.col("total_spend"), 4).alias("total_spend"),
        rounded(F.col("avg_locations"), 6).alias("avg_locations"), "max_locations", "category_breadth")


@query("A15_savings_pct", sql(f"""
SELECT segment, {r('CAST(total_savings AS DOUBLE) / (CAST(total_list_price AS DOUBLE) + 1e-9) * 100', 6)} AS savings_pct
FROM {_SEG}""", "seg_month"))
def savings(spark, folder):
    return rollup.segment_totals(full_segment_month(spark, folder)).select(
        "segment", rounded(F.col("savings_pct"), 6).alias("savings_pct"))


@query("A16_ecomm_penetration", sql(f"""
SELECT segment, count(*) FILTER (upper(ecomm_status) = 'ACTIVE') AS ecomm_active, count(customer_id) AS total_locations,
  {r("count(*) FILTER (upper(ecomm_status) = 'ACTIVE') / CAST(count(customer_id) AS DOUBLE)", 6)} AS ecomm_penetration
FROM (SELECT customer_id, min(segment) AS segment,
    CASE WHEN bool_or(upper(ecomm_status) = 'ACTIVE') THEN 'ACTIVE' ELSE max(ecomm_status) END AS ecomm_status
  FROM fact GROUP BY customer_id) GROUP BY segment""", "fact"))
def penetration(spark, folder):
    customers = marts.customer_summary(fact(spark, folder, "customer_id", "segment", "ecomm_status", "spend"))
    return rollup.ecomm_penetration(customers).withColumn(
        "ecomm_penetration", rounded(F.col("ecomm_penetration"), 6))


_BUCKET = """CASE WHEN rooms < 100 THEN '<100 rooms' WHEN rooms < 250 THEN '100–250'
  WHEN rooms < 500 THEN '250–500' WHEN rooms < 1000 THEN '500–1000' ELSE '1000+' END"""


def _properties(spark, folder):
    return rollup.properties(fact(spark, folder, "segment", "customer_id", "rooms", "spend"))


@query("A17_spend_per_room_by_size", sql(f"""
SELECT {_BUCKET} AS size_bucket, {r('sum(spend)')} AS total_spend, sum(rooms) AS total_rooms,
  CAST(sum(records) AS BIGINT) AS record_count,
  {r('CAST(sum(spend) AS DOUBLE) / greatest(sum(rooms), 1)')} AS spend_per_room FROM props GROUP BY ALL""", "props"))
def per_room(spark, folder):
    df = _properties(spark, folder).withColumn("size_bucket", rollup.size_bucket())
    return _money(rollup.spend_per_room(df, ["size_bucket"]), "total_spend", "spend_per_room").drop("avg_rooms")


@query("A18_spend_per_room_by_segment", sql(f"""
SELECT segment, {r('avg(rooms)', 6)} AS avg_rooms, {r('CAST(sum(spend) AS DOUBLE) / greatest(sum(rooms), 1)')} AS spend_per_room,
  {r('sum(spend)')} AS total_spend FROM props GROUP BY ALL HAVING avg(rooms) > 0""", "props"))
def per_room_segment(spark, folder):
    df = rollup.spend_per_room(_properties(spark, folder), ["segment"]).filter("avg_rooms > 0")
    return df.select("segment", rounded(F.col("avg_rooms"), 6).alias("avg_rooms"),
                     rounded(F.col("spend_per_room"), 4).alias("spend_per_room"),
                     rounded(F.col("total_spend"), 4).alias("total_spend"))


@query("A19_ecomm_share", sql(f"""
SELECT ecomm_status, {r('s')} AS total_spend, {r('CAST(s AS DOUBLE) * 100 / sum(CAST(s AS DOUBLE)) OVER ()', 6)} AS share_pct
FROM (SELECT ecomm_status, sum(spend) AS s FROM fact GROUP BY ALL)""", "fact"))
def ecomm_share(spark, folder):
    df = fact(spark, folder, "ecomm_status", "spend").groupBy("ecomm_status").agg(F.sum("spend").alias("total_spend"))
    return mix.with_share(df, "total_spend").select(
        "ecomm_status", rounded(F.col("total_spend"), 4).alias("total_spend"),
        rounded(F.col("share_pct"), 6).alias("share_pct"))


def _pivot_sql(rows: str, column: str, values: list[str], where: str = "", tail: str = "") -> str:
    cells = ", ".join(f"""{r(f"coalesce(sum(spend) FILTER ({column} = '{v}'), 0)")} AS "{v}" """ for v in values)
    return f"SELECT {rows}, {cells} FROM fact {where} GROUP BY ALL {tail}"


@query("A20_state_category_pivot", sql(_pivot_sql("state", "cat_l1", CATEGORIES), "fact"))
def state_category(spark, folder):
    return _money(rollup.pivot_sum(fact(spark, folder, "state", "cat_l1", "spend"), ["state"], "cat_l1", CATEGORIES),
                  *CATEGORIES)


_STATUS = ["ACTIVE", "INACTIVE", "PENDING"]


@query("A21_brand_status_pivot", sql(
    _pivot_sql("cat_l2", "ecomm_status", _STATUS, tail="ORDER BY \"ACTIVE\" DESC, cat_l2 LIMIT 15"), "fact"))
def brand_status(spark, folder):
    wide = rollup.pivot_sum(fact(spark, folder, "cat_l2", "ecomm_status", "spend"), ["cat_l2"], "ecomm_status", _STATUS)
    return _money(top_rows(wide, 15, "ACTIVE", "cat_l2"), *_STATUS)


@query("A22_category_status_pivot", sql(_pivot_sql(
    "cat_l1", "ecomm_status", _STATUS[:2], "WHERE ecomm_status IN ('ACTIVE', 'INACTIVE')"), "fact"))
def category_status(spark, folder):
    df = clean.only_members(fact(spark, folder, "cat_l1", "ecomm_status", "spend"), "ecomm_status", _STATUS[:2])
    return _money(rollup.pivot_sum(df, ["cat_l1"], "ecomm_status", _STATUS[:2]), *_STATUS[:2])


_QUARTER = "'Q' || CAST((year_month % 100 + 2) // 3 AS VARCHAR) || ' ' || CAST(year_month // 100 AS VARCHAR)"


@query("A23_segment_quarter_pivot", sql(_pivot_sql("segment", _QUARTER, QUARTERS).replace(
    "FROM fact", "FROM (SELECT * FROM fact WHERE year_month BETWEEN 200001 AND 200106)"), "fact"))
def segment_quarter(spark, folder):
    df = segment_month(spark, folder).filter(F.col("year_month").between(200001, 200106))
    return _money(rollup.pivot_sum(growth.quarters(df, ["segment"]), ["segment"], "quarter", QUARTERS), *QUARTERS)


@query("A24_quarters_actual_else_forecast", sql(f"""
SELECT segment, {_QUARTER} AS quarter, {r('sum(spend)')} AS spend
FROM (SELECT segment, year_month, coalesce(a.spend, f.spend, 0) AS spend
  FROM (SELECT * FROM seg_month WHERE year_month <= {CUTOFF}) a
  FULL JOIN (SELECT segment, year_month + 100 AS year_month, spend FROM seg_month
             WHERE year_month BETWEEN 200001 AND 200006) f USING (segment, year_month))
WHERE year_month BETWEEN 200001 AND 200106 GROUP BY ALL""", "seg_month"))
def quarters(spark, folder):
    panel = segment_panel(spark, folder)
    ahead = panel.filter(F.col("year_month").between(200001, 200006)).withColumn(
        "year_month", F.col("year_month") + 100)
    merged = growth.actual_or_forecast(panel.filter(F.col("year_month") <= CUTOFF), ahead, ["segment"])
    inside = merged.filter(F.col("year_month").between(200001, 200106))
    return _money(growth.quarters(inside, ["segment"]).drop("quarter_no"), "spend")


_RESIDUAL = """(SELECT CAST(spend AS DOUBLE) / 1000 - avg(CAST(spend AS DOUBLE) / 1000) OVER (PARTITION BY state) AS e
  FROM state_month)"""


@query("A25_residual_moments", sql(f"""
SELECT CAST(count(e) AS DOUBLE) AS n, {r('avg(e)', 6)} AS mean, {r('stddev_samp(e)')} AS std, {r('min(e)')} AS min,
  {r('max(e)')} AS max, {r('skewness(e)', 6)} AS skew, {r('kurtosis(e)', 6)} AS kurtosis FROM {_RESIDUAL}""", "state_month"))
def residual_moments(spark, folder):
    panel = state_panel(spark, folder).withColumn("y", F.col("spend").cast("double") / 1000)
    means = panel.groupBy("state").agg(F.avg("y").alias("m"))
    out = stats.residual_moments(panel.join(means, "state").withColumn("e", F.col("y") - F.col("m")), "e")
    return out.select("n", rounded(F.col("mean"), 6).alias("mean"),
                      *[rounded(F.col(c), 4).alias(c) for c in ("std", "min", "max")],
                      *[rounded(F.col(c), 6).alias(c) for c in ("skew", "kurtosis")])


@query("A26_histogram", sql("""
SELECT CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT ln(1 + CAST(total_spend AS DOUBLE)) AS x FROM customers),
  (SELECT min(ln(1 + CAST(total_spend AS DOUBLE))) AS lo, max(ln(1 + CAST(total_spend AS DOUBLE))) AS hi FROM customers)
GROUP BY ALL""", "customers"))
def histogram(spark, folder):
    df = settle(customer_spend(spark, folder)).withColumn("x", F.log1p(F.col("total_spend").cast("double")))
    return stats.histogram(df, "x", 50)


@query("A27_box_numbers", sql(f"""
SELECT segment, {r('q25')} AS q25, {r('q50')} AS q50, {r('q75')} AS q75,
  {r('min(x) FILTER (x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))')} AS whisker_low,
  {r('max(x) FILTER (x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))')} AS whisker_high,
  count(*) FILTER (NOT x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS outliers
FROM (SELECT segment, CAST(spend AS DOUBLE) AS x FROM fact) JOIN (SELECT segment,
  quantile_cont(CAST(spend AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(spend AS DOUBLE), 0.5) AS q50,
  quantile_cont(CAST(spend AS DOUBLE), 0.75) AS q75 FROM fact GROUP BY ALL) USING (segment) GROUP BY segment, q25, q50, q75
""", "fact"))
def box(spark, folder):
    return _money(stats.box_numbers(fact(spark, folder, "segment", "spend"), "segment", "spend"),
                  "q25", "q50", "q75", "whisker_low", "whisker_high")


@query("A28_gini", sql(f"""
SELECT count(*) AS n, {r('2 * CAST(sum(i * v) AS DOUBLE) / (count(*) * CAST(sum(v) AS DOUBLE)) - (count(*) + 1) / CAST(count(*) AS DOUBLE)', 8)} AS gini
FROM (SELECT v, row_number() OVER (ORDER BY v, client_id) AS i
  FROM (SELECT client_id, sum(spend) AS v FROM fact GROUP BY ALL))""", "fact"))
def gini(spark, folder):
    clients = fact(spark, folder, "client_id", "spend").groupBy("client_id").agg(F.sum("spend").alias("total_spend"))
    return ranking.gini(clients, "client_id").withColumn("gini", rounded(F.col("gini"), 8))


@query("A29_peak_and_trough", sql(f"""
SELECT segment, arg_max(year_month, (spend, -year_month)) AS peak_month, {r('max(spend)')} AS peak_value,
  arg_min(year_month, (spend, year_month)) AS trough_month, {r('min(spend)')} AS trough_value
FROM seg_month GROUP BY ALL""", "seg_month"))
def peaks(spark, folder):
    return _money(rollup.extremes(segment_month(spark, folder), ["segment"]), "peak_value", "trough_value")


@query("A31_monthly_variation", sql(f"""
SELECT segment, {r('stddev_pop(CAST(spend AS DOUBLE)) / avg(CAST(spend AS DOUBLE))', 6)} AS monthly_cv
FROM dense GROUP BY ALL""", "dense"))
def variation(spark, folder):
    dense = trend.densify(segment_panel(spark, folder), ["segment"])
    return rollup.variation(dense, "segment").withColumn("monthly_cv", rounded(F.col("monthly_cv"), 6))


@query("A32_category_entropy", sql(f"""
SELECT customer_id, {r('-sum(p * log2(p))', 6)} AS entropy
FROM (SELECT customer_id, CAST(v AS DOUBLE) / sum(CAST(v AS DOUBLE)) OVER (PARTITION BY customer_id) AS p
  FROM (SELECT customer_id, cat_l1, sum(spend) AS v FROM fact GROUP BY ALL)) GROUP BY ALL""", "fact"))
def entropy(spark, folder):
    df = rollup.entropy_bits(fact(spark, folder, "customer_id", "cat_l1", "spend"), "customer_id", "cat_l1")
    return df.withColumn("entropy", rounded(F.col("entropy"), 6))


@query("A33_customer_activity", sql("""
SELECT customer_id, count(DISTINCT year_month) AS active_months, count(DISTINCT cat_l1) AS category_breadth
FROM fact GROUP BY ALL""", "fact"))
def activity(spark, folder):
    return rollup.customer_activity(fact(spark, folder, "customer_id", "year_month", "cat_l1"))
