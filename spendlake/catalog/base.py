"""Registry, frames over the given tables, and the matching SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import rollup
from ..plans import marts
from ..session import settle
from ..sources import star

# The given tables run from 1995-01 to 2001-08.
YEAR = (200001, 200012)
CUTOFF = 200012
HORIZON = [200101, 200102, 200103, 200104, 200105, 200106]
NOW, BEFORE = (200104, 200106), (200004, 200006)
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
QUARTERS = ["Q1 2000", "Q2 2000", "Q3 2000", "Q4 2000", "Q1 2001", "Q2 2001"]
STATES = [f"NATION_{i}" for i in range(20)]


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id and a short name."""
    def keep(run):
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run
    return keep


# Frames ------------------------------------------------------------------------------

def fact(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return star.spend_fact(spark, folder, *columns)


def detail(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.customer_month(fact(
        spark, folder, "segment", "client_id", "customer_id", "state", "cat_l1", "year_month",
        "spend", "list_price", "savings"))


def state_month(spark: SparkSession, folder: str) -> DataFrame:
    return fact(spark, folder, "state", "year_month", "spend").groupBy("state", "year_month").agg(
        F.sum("spend").alias("spend"))


def segment_month(spark: SparkSession, folder: str) -> DataFrame:
    return fact(spark, folder, "segment", "year_month", "spend").groupBy("segment", "year_month").agg(
        F.sum("spend").alias("spend"))


def month_total(spark: SparkSession, folder: str) -> DataFrame:
    return fact(spark, folder, "year_month", "spend").groupBy("year_month").agg(
        F.sum("spend").alias("spend"))


def customer_spend(spark: SparkSession, folder: str) -> DataFrame:
    return fact(spark, folder, "customer_id", "spend").groupBy("customer_id").agg(
        F.sum("spend").alias("total_spend"))


def customer_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Customer profile of all lines. Distributors are counted by number: a set of numbers is shorter to shuffle than one of texts."""
    lines = fact(spark, folder, "customer_id", "cat_l1", "distributor_no", "rooms", "spend")
    return rollup.customer_profile(lines.withColumnRenamed("distributor_no", "distributor_id"))


def state_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rollup.key_stats(fact(spark, folder, "state", "spend"), "state")


def state_panel(spark: SparkSession, folder: str) -> DataFrame:
    """State-month spend as a settled mart, for queries that read it several times."""
    return settle(state_month(spark, folder))


def segment_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Segment-month spend as a settled mart."""
    return settle(segment_month(spark, folder))


def mix_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Segment-category spend as a settled mart: both mix levels are sums of it."""
    return settle(fact(spark, folder, "segment", "cat_l1", "spend").groupBy("segment", "cat_l1").agg(
        F.sum("spend").alias("spend")))


def full_segment_month(spark: SparkSession, folder: str) -> DataFrame:
    return marts.segment_month(detail(spark, folder))


# SQL ---------------------------------------------------------------------------------

_STEP = "(event_id % 80)"
_EVENT_MONTH = f"CAST((1995 + {_STEP} // 12) * 100 + {_STEP} % 12 + 1 AS INTEGER)"
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "fact": ((), """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS year_month,
  o_orderpriority AS entity_type, c_mktsegment AS segment,
  CAST(o_custkey // 10 AS VARCHAR) AS client_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  n_name AS state,
  CASE WHEN o_custkey % 3 <> 0 THEN CAST(20 + o_custkey % 1200 AS DOUBLE) END AS rooms,
  CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'INACTIVE' ELSE 'PENDING' END AS ecomm_status,
  CAST(l_suppkey AS VARCHAR) AS distributor_id, CAST(s_nationkey AS VARCHAR) AS distributor_group,
  p_brand AS manufacturer_id, CAST(l_partkey AS VARCHAR) AS category_id,
  p_type AS cat_l1, p_brand AS cat_l2, CAST(p_size // 10 AS VARCHAR) AS cat_l3,
  CASE WHEN p_partkey % 3 <> 0 THEN 'L4-' || CAST(p_partkey % 7 AS VARCHAR) END AS cat_l4,
  CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS spend,
  CAST(l_extendedprice AS DECIMAL(18,4)) AS list_price,
  CAST(l_extendedprice AS DECIMAL(18,4)) - CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS savings
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey"""),
    # The digamma function at whole numbers, by its sum.
    "psi": (("fact",), """
SELECT i AS n, -0.57721566490153286061::DOUBLE + coalesce(sum(1 / CAST(i AS DOUBLE)) OVER (
    ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h
FROM (SELECT unnest(range(1, (SELECT count(*) FROM fact) + 1)) AS i)"""),
    "detail": (("fact",), """
SELECT segment, client_id, customer_id, state, cat_l1, year_month,
  sum(spend) AS spend, sum(list_price) AS list_price, sum(savings) AS savings
FROM fact GROUP BY ALL"""),
    "state_month": (("fact",), "SELECT state, year_month, sum(spend) AS spend FROM fact GROUP BY ALL"),
    "seg_month": (("fact",), """
SELECT segment, year_month, sum(spend) AS spend, sum(list_price) AS list_price,
  sum(savings) AS savings, count(DISTINCT customer_id) AS locations,
  count(DISTINCT client_id) AS clients, count(DISTINCT cat_l1) AS categories
FROM fact GROUP BY ALL"""),
    "month_total": (("fact",), "SELECT year_month, sum(spend) AS spend FROM fact GROUP BY ALL"),
    "customers": (("fact",), "SELECT customer_id, sum(spend) AS total_spend FROM fact GROUP BY ALL"),
    "ev": ((), f"""
SELECT 'NATION_' || CAST(user_id % 25 AS VARCHAR) AS state, {_EVENT_MONTH} AS year_month,
  event_type || '-' || CAST(event_id AS VARCHAR) AS name, least(100.0, value) AS score FROM events"""),
    "uplift": ((), f"""
SELECT 'NATION_' || CAST(user_id % 25 AS VARCHAR) AS state, {_EVENT_MONTH} AS year_month,
  CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / 100 AS uplift_m
FROM events WHERE event_type = 'purchase' GROUP BY ALL"""),
    "ev_score": (("ev",), """
SELECT state, year_month, CAST(round(sum(CAST(score AS DECIMAL(10,2))
    * CAST(pow(0.5, rn - 1) AS DECIMAL(20,16))), 4) AS DOUBLE) AS event_score
FROM (SELECT *, row_number() OVER (PARTITION BY state, year_month ORDER BY score DESC, name) AS rn FROM ev)
GROUP BY ALL"""),
    "ev_count": (("ev",), """
SELECT state, year_month, count(*) AS event_count, max(score) AS max_event FROM ev GROUP BY ALL"""),
    "ref": (("fact", "ev"), """
SELECT n_name AS state, population_m, gdp_b, tourism_b, hotel_count, hotel_rooms_k, event_count
FROM nation
  JOIN (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS population_m,
    CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS gdp_b FROM customer GROUP BY ALL)
    ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT s_nationkey, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS tourism_b,
    CAST(count(*) AS DOUBLE) AS hotel_count FROM supplier GROUP BY ALL) ON n_nationkey = s_nationkey
  LEFT JOIN (SELECT state AS ps, CAST(count(DISTINCT category_id) AS DOUBLE) AS hotel_rooms_k
    FROM fact GROUP BY ALL) ON n_name = ps
  LEFT JOIN (SELECT state AS es, CAST(count(*) AS DOUBLE) AS event_count FROM ev GROUP BY ALL)
    ON n_name = es"""),
    "labels": ((), """
SELECT DISTINCT c_mktsegment AS segment,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS label
FROM customer WHERE c_mktsegment <> 'MACHINERY'"""),
    "state_tot": (("fact",), """
SELECT state, sum(spend) AS total_spend, CAST(sum(spend) AS DOUBLE) / count(spend) AS avg_spend,
  count(spend) AS transactions FROM fact GROUP BY ALL"""),
    "profile": (("fact",), """
SELECT customer_id, sum(spend) AS total_spend, CAST(sum(spend) AS DOUBLE) / count(spend) AS avg_spend,
  count(spend) AS transactions, count(DISTINCT cat_l1) AS unique_categories,
  count(DISTINCT distributor_id) AS unique_distributors,
  max(CASE WHEN rooms IS NOT NULL THEN 1 ELSE 0 END) AS has_rooms FROM fact GROUP BY ALL"""),
    "mix": (("fact",), """
SELECT segment, cat_l1, total_spend,
  CAST(total_spend AS DOUBLE) * 100 / CAST(sum(total_spend) OVER (PARTITION BY segment) AS DOUBLE) AS pct
FROM (SELECT segment, cat_l1, sum(spend) AS total_spend FROM fact GROUP BY ALL)"""),
    "natmix": (("fact",), """
SELECT cat_l1, total_spend, CAST(total_spend AS DOUBLE) * 100 / CAST(sum(total_spend) OVER () AS DOUBLE) AS pct
FROM (SELECT cat_l1, sum(spend) AS total_spend FROM fact GROUP BY ALL)"""),
    "props": (("fact",), """
SELECT segment, customer_id, rooms, sum(spend) AS spend, count(*) AS records
FROM fact WHERE rooms IS NOT NULL GROUP BY ALL"""),
    "dense": (("fact",), """
SELECT s.segment, m.year_month, m.month_no, coalesce(f.spend, 0) AS spend
FROM (SELECT DISTINCT segment FROM fact) s
  CROSS JOIN (SELECT year_month, row_number() OVER (ORDER BY year_month) - 1 AS month_no
              FROM (SELECT DISTINCT year_month FROM fact)) m
  LEFT JOIN (SELECT segment, year_month, sum(spend) AS spend FROM fact GROUP BY ALL) f
    ON f.segment = s.segment AND f.year_month = m.year_month"""),
    "trend": (("dense",), """
SELECT segment, count(*) AS n, regr_slope(y, x) AS slope, regr_slope(y, x) / avg(y) AS slope_norm,
  regr_r2(y, x) AS r2, avg(y) FILTER (x < 3) AS q1_avg, avg(y) FILTER (x > mx - 3) AS q4_avg,
  (avg(y) FILTER (x > mx - 3) - avg(y) FILTER (x < 3)) / avg(y) FILTER (x < 3) AS momentum,
  stddev_pop(y) / avg(y) AS volatility,
  CAST(arg_max(x, (spend, -x)) AS INTEGER) AS best_month, CAST(arg_min(x, (spend, x)) AS INTEGER) AS worst_month
FROM (SELECT segment, spend, CAST(spend AS DOUBLE) AS y, month_no AS x,
        max(month_no) OVER (PARTITION BY segment) AS mx FROM dense) GROUP BY segment"""),
    "lagged": (("state_month",), """
SELECT state, year_month, spend, coalesce(a, 0) AS lag1, coalesce(b, a, 0) AS lag2,
  coalesce(c, b, a, 0) AS lag3, (coalesce(a, 0) + coalesce(b, a, 0) + coalesce(c, b, a, 0)) / 3 AS roll3
FROM (SELECT *, ln(1 + CAST(lag(spend, 1) OVER w AS DOUBLE)) AS a,
        ln(1 + CAST(lag(spend, 2) OVER w AS DOUBLE)) AS b, ln(1 + CAST(lag(spend, 3) OVER w AS DOUBLE)) AS c
      FROM state_month WINDOW w AS (PARTITION BY state ORDER BY year_month))"""),
    "growth": (("state_month",), f"""
SELECT state, sum(CASE WHEN year_month BETWEEN {NOW[0]} AND {NOW[1]} THEN spend ELSE 0 END) AS now_spend,
  sum(CASE WHEN year_month BETWEEN {BEFORE[0]} AND {BEFORE[1]} THEN spend ELSE 0 END) AS before_spend
FROM state_month WHERE year_month BETWEEN {NOW[0]} AND {NOW[1]} OR year_month BETWEEN {BEFORE[0]} AND {BEFORE[1]}
GROUP BY ALL"""),
    "growth_pct": (("growth",), """
SELECT *, coalesce(CAST((now_spend - before_spend) * 100 AS DOUBLE)
  / nullif(CAST(before_spend AS DOUBLE), 0), 0) AS growth_pct FROM growth"""),
    "naive": (("state_month",), """
SELECT s.state, s.year_month, CAST(s.spend AS DOUBLE) AS actual, n.model, n.prediction
FROM state_month s JOIN (
  SELECT state, year_month, unnest(['last', 'mean3', 'year_ago']) AS model,
    unnest([a, (a + b + c) / 3, y]) AS prediction
  FROM (SELECT m.state, m.year_month, CAST(lag(m.spend, 1) OVER w AS DOUBLE) AS a,
      CAST(lag(m.spend, 2) OVER w AS DOUBLE) AS b, CAST(lag(m.spend, 3) OVER w AS DOUBLE) AS c,
      CAST(p.spend AS DOUBLE) AS y
    FROM state_month m LEFT JOIN state_month p ON p.state = m.state AND p.year_month = m.year_month - 100
    WINDOW w AS (PARTITION BY m.state ORDER BY m.year_month))
  ) n ON n.state = s.state AND n.year_month = s.year_month WHERE n.prediction IS NOT NULL"""),
}


def sql(body: str, *parts: str) -> str:
    """``WITH`` the named parts and all they need, then the body."""
    seen: list[str] = []

    def add(name: str) -> None:
        for other in _PARTS[name][0]:
            add(other)
        if name not in seen:
            seen.append(name)

    for part in parts:
        add(part)
    lead = ",\n".join(f"{name} AS ({_PARTS[name][1].strip()})" for name in seen)
    return (f"WITH {lead}\n" if lead else "") + body.strip()


def r(expr: str, digits: int = 4) -> str:
    """Rounded double in SQL; adding zero turns -0.0 into 0.0."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def least_squares_sql(points: str, n: int, alpha: float = 0.0, guard: str = "") -> str:
    """``i, b``: coefficients of ``y`` on ``n`` standardised inputs, by elimination in the normal equations.

    ``points`` has ``f`` (a list of n numbers) and ``y``. ``alpha`` is added to the diagonal, ``guard`` to the deviations.
    """
    steps = "".join(f""",
  e{k} AS MATERIALIZED (SELECT a.i, CASE WHEN a.i = {k} THEN a.v ELSE list_transform(range(1, {n + 2}),
      lambda j: a.v[j] - a.v[{k}] / p.v[{k}] * p.v[j]) END AS v FROM e{k - 1} a, (SELECT v FROM e{k - 1} WHERE i = {k}) p)"""
                    for k in range(1, n + 1))
    return f"""(WITH
  numbered AS MATERIALIZED (SELECT f, y, row_number() OVER () AS r FROM ({points})),
  long AS (SELECT r, y, unnest(f) AS x, unnest(range(1, {n + 1})) AS j FROM numbered),
  z AS MATERIALIZED (SELECT r, j, coalesce((x - avg(x) OVER (PARTITION BY j)) / nullif(stddev_pop(x) OVER (PARTITION BY j){guard}, 0), 0) AS z,
    y - avg(y) OVER (PARTITION BY j) AS y FROM long),
  products AS (SELECT a.j AS i, b.j AS j, sum(a.z * b.z) AS v FROM z a JOIN z b USING (r) GROUP BY a.j, b.j),
  gram AS (SELECT i, j, v + CASE WHEN i = j THEN {alpha} ELSE 0 END AS v FROM products
    UNION ALL SELECT j, {n + 1}, sum(z * y) FROM z GROUP BY j),
  e0 AS MATERIALIZED (SELECT i, list(v ORDER BY j) AS v FROM gram GROUP BY i){steps}
  SELECT i, v[{n + 1}] / v[i] AS b FROM e{n})"""
