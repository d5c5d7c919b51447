"""Rollups. Sums are partial on the map side, so a hot key costs no more than others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType

from ..functions import ratio_or_zero
from ..schema import DETAIL_KEYS
from .clean import known_keys


def customer_month(fact: DataFrame) -> DataFrame:
    """Purchase lines -> one row per customer, category and month.

    A missing key is a group of its own, so no spend is lost here; each rollup leaves out
    only the rows that lack a key of its own.
    """
    measures = [name for name in ("spend", "list_price", "savings") if name in fact.columns]
    return (fact.groupBy(*DETAIL_KEYS)
            .agg(*[F.sum(name).alias(name) for name in measures]))


def month_rollup(detail: DataFrame, keys: list[str], sums: list[str],
                 distinct: dict[str, str]) -> DataFrame:
    """Sums and distinct counts per key and month.

    ``distinct`` maps an output name to the column counted. Spark counts distincts by
    grouping on (key, value) first, so no task holds the values of one key.
    """
    grain = [*keys, "year_month"]
    return known_keys(detail, grain).groupBy(*grain).agg(
        *[F.sum(name).alias(name) for name in sums],
        *[F.count_distinct(column).alias(name) for name, column in distinct.items()])


def two_levels(df: DataFrame, fine: list[str], coarse: list[str],
               values: list[str], total_label: str, total_key: str) -> DataFrame:
    """Two grouping levels in one pass; the coarse rows carry ``total_label``.

    The fine level is summed first, so that only its sums are doubled for the coarse one.
    """
    is_total = F.grouping(total_key).alias("is_total")
    sums = known_keys(df, fine).groupBy(*fine).agg(*[F.sum(name).alias(name) for name in values])
    grouped = sums.groupingSets([fine, coarse], *fine).agg(*[F.sum(name).alias(name) for name in values], is_total)
    label = F.when(F.col("is_total") == 1, F.lit(total_label)).otherwise(F.col(total_key))
    return grouped.withColumn(total_key, label).drop("is_total")


def key_stats(df: DataFrame, key: str, value: str = "spend") -> DataFrame:
    """Sum, mean and count of known values per key."""
    return known_keys(df, [key]).groupBy(key).agg(
        F.sum(value).alias("total_spend"), F.avg(value).alias("avg_spend"),
        F.count(value).alias("transactions"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each known value occurs."""
    return known_keys(df, [column]).groupBy(column).agg(F.count("*").alias("n"))


def customer_profile(fact: DataFrame) -> DataFrame:
    """Spend, activity and breadth per customer.

    One grouping, and so one shuffle: sums and the sets of distinct values are partial on the map side.
    Counting two distinct columns would shuffle a copy of every line for each of them, twice. A set
    holds the categories, or the distributors, of one customer once each, however many lines there are.
    """
    kind = fact.schema["spend"].dataType
    if isinstance(kind, DecimalType):  # room for the sum of all lines, and with it the digits of the mean
        kind = DecimalType(min(kind.precision + 10, 38), kind.scale)
    spend, n = F.sum(F.col("spend").cast(kind)), F.count("spend")
    breadth = lambda c: F.size(F.collect_set(c)).cast("long")
    return known_keys(fact, ["customer_id"]).groupBy("customer_id").agg(
        spend.alias("total_spend"), F.try_divide(spend, n).alias("avg_spend"), n.alias("transactions"),
        breadth("cat_l1").alias("unique_categories"), breadth("distributor_id").alias("unique_distributors"),
        F.max(F.col("rooms").isNotNull().cast("int")).alias("has_rooms"))


def customer_activity(fact: DataFrame) -> DataFrame:
    """Months with purchases and category breadth per customer, counted over distinct cells."""
    cells = known_keys(fact, ["customer_id"]).select("customer_id", "year_month", "cat_l1").distinct()
    return cells.groupBy("customer_id").agg(
        F.count_distinct("year_month").alias("active_months"),
        F.count_distinct("cat_l1").alias("category_breadth"))


def segment_totals(segment_month: DataFrame, key: str = "segment") -> DataFrame:
    """Per segment over its present months: totals, averages and maxima."""
    rolled = segment_month.groupBy(key).agg(
        F.sum("spend").alias("total_spend"), F.sum("list_price").alias("total_list_price"),
        F.sum("savings").alias("total_savings"), F.avg("locations").alias("avg_locations"),
        F.max("locations").alias("max_locations"), F.max("categories").alias("category_breadth"))
    return rolled.withColumn("savings_pct", savings_pct("total_savings", "total_list_price"))


def savings_pct(savings: str, list_price: str) -> Column:
    return F.col(savings).cast("double") / (F.col(list_price).cast("double") + 1e-9) * 100


def ecomm_penetration(customers: DataFrame) -> DataFrame:
    """Share of a segment's customers that order online, from one grouping."""
    active = F.count_if((F.upper("ecomm") == "ACTIVE") & F.col("customer_id").isNotNull())
    return known_keys(customers, ["segment"]).groupBy("segment").agg(
        active.alias("ecomm_active"), F.count("customer_id").alias("total_locations")
    ).withColumn("ecomm_penetration", ratio_or_zero(F.col("ecomm_active"), F.col("total_locations")))


def size_bucket(rooms: str = "rooms") -> Column:
    """Property size class by number of rooms."""
    col = F.col(rooms)
    return (F.when(col < 100, "<100 rooms").when(col < 250, "100–250").when(col < 500, "250–500")
            .when(col < 1000, "500–1000").when(col.isNotNull(), "1000+"))


def size_order(bucket: str = "size_bucket") -> Column:
    """Sort key of a size class."""
    col = F.col(bucket)
    return (F.when(col == "<100 rooms", 1).when(col == "100–250", 2).when(col == "250–500", 3)
            .when(col == "500–1000", 4).when(col == "1000+", 5))


def properties(fact: DataFrame) -> DataFrame:
    """One row per customer with a known room number: rooms, spend and line count."""
    return (fact.filter(F.col("rooms").isNotNull())
            .groupBy("segment", "customer_id", "rooms")
            .agg(F.sum("spend").alias("spend"), F.count("*").alias("records")))


def spend_per_room(props: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of spend over sum of rooms, the latter at least 1."""
    rolled = props.groupBy(*keys).agg(
        F.sum("spend").alias("total_spend"), F.sum("rooms").alias("total_rooms"),
        F.sum("records").alias("record_count"), F.avg("rooms").alias("avg_rooms"))
    quotient = F.col("total_spend").cast("double") / F.greatest(F.col("total_rooms"), F.lit(1.0))
    return rolled.withColumn("spend_per_room", quotient)


def pivot_sum(df: DataFrame, rows: list[str], column: str, values: list[str],
              value: str = "spend") -> DataFrame:
    """Long to wide with declared columns, missing cells 0."""
    wide = known_keys(df, rows).groupBy(*rows).pivot(column, values).agg(F.sum(value))
    zero = F.lit(0)
    return wide.select(*rows, *[F.coalesce(F.col(f"`{v}`"), zero).alias(v) for v in values])


def variation(df: DataFrame, key: str, value: str = "spend") -> DataFrame:
    """Population deviation over mean of a key's months."""
    x = F.col(value).cast("double")
    return df.groupBy(key).agg(
        F.try_divide(F.stddev_pop(x), F.avg(x)).alias("monthly_cv"))


def extremes(df: DataFrame, keys: list[str], value: str = "spend",
             month: str = "year_month") -> DataFrame:
    """Peak and trough month of each series; the earliest month wins a tie."""
    early = F.struct(F.col(value), -F.col(month))
    return df.groupBy(*keys).agg(
        F.max_by(month, early).alias("peak_month"), F.max(value).alias("peak_value"),
        F.min_by(month, F.struct(F.col(value), F.col(month))).alias("trough_month"),
        F.min(value).alias("trough_value"))


def entropy_bits(df: DataFrame, key: str, category: str, value: str = "spend") -> DataFrame:
    """Shannon entropy, in bits, of how a key's purchases spread over categories.

    With p = v / total: H = log2(total) - sum(v log2 v) / total, so two partial
    aggregations do it without a window over the key.
    """
    cells = (known_keys(df, [key, category]).groupBy(key, category)
             .agg(F.sum(value).cast("double").alias("v")).filter("v > 0"))
    total = F.sum("v")
    return cells.groupBy(key).agg(
        (F.log2(total) - F.sum(F.col("v") * F.log2("v")) / total).alias("entropy"))
