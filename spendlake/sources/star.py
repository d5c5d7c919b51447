"""Adapter: order-line star tables -> spend fact and its dimensions.

Only the tables that the requested columns need are joined, and a line without a match keeps
its other columns, so the rows do not depend on the columns asked for. Dimension joins carry no
broadcast hint: Spark broadcasts a side whose size it knows to be small and sorts and
merges both sides beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import MONEY

_ORDER = {"year_month", "entity_type", "ecomm_status", "customer_id", "client_id", "rooms",
          "segment", "state"}
_CUSTOMER = {"segment", "state"}
_NATION = {"state"}
_PART = {"cat_l1", "cat_l2", "cat_l3", "cat_l4", "manufacturer_id"}
_SUPPLIER = {"distributor_group"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _expressions() -> dict[str, F.Column]:
    """Fact column -> expression over the joined star tables."""
    key = F.col("o_custkey")
    spend, listed = F.col("l_spend"), F.col("l_listed")
    status = (F.when(F.col("o_orderstatus") == "F", "ACTIVE")
              .when(F.col("o_orderstatus") == "O", "INACTIVE").otherwise("PENDING"))
    return {
        "row_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "year_month": F.col("o_month"),
        "entity_type": F.col("o_orderpriority"),
        "segment": F.col("c_mktsegment"),
        "client_id": F.floor(key / 10).cast("string"),
        "customer_id": key.cast("string"),
        "state": F.col("n_name"),
        "rooms": F.when(key % 3 != 0, (20 + key % 1200).cast("double")),
        "ecomm_status": status,
        "distributor_id": F.col("l_suppkey").cast("string"),
        "distributor_no": F.col("l_suppkey"),
        "distributor_group": F.col("s_nationkey").cast("string"),
        "manufacturer_id": F.col("p_brand"),
        "category_id": F.col("l_partkey").cast("string"),
        "cat_l1": F.col("p_type"),
        "cat_l2": F.col("p_brand"),
        "cat_l3": F.col("p_band"),
        "cat_l4": F.col("p_depth4"),
        "spend": spend,
        "list_price": listed,
        "savings": (listed - spend).cast(MONEY),
    }


#: ``distributor_no`` is ``distributor_id`` as a number, and comes only when named.
FACT_COLUMNS = [
    "row_id", "year_month", "entity_type", "segment", "client_id", "customer_id", "state",
    "rooms", "ecomm_status", "distributor_id", "distributor_group", "manufacturer_id",
    "category_id", "cat_l1", "cat_l2", "cat_l3", "cat_l4", "spend", "list_price", "savings",
]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their money, worked out before a join moves them: one number a line instead of price and discount."""
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").withColumns({
        "l_spend": (price * (1 - F.col("l_discount"))).cast(MONEY), "l_listed": price.cast(MONEY)})


def _orders(spark: SparkSession, folder: str, need: set[str]) -> DataFrame:
    """Orders with their month, which moves in place of the date."""
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    return table(spark, folder, "orders").withColumns({"o_month": month.cast("int")} if "year_month" in need else {})


def _parts(spark: SparkSession, folder: str, need: set[str]) -> DataFrame:
    """Parts with the categories that follow from their size and key, so that neither moves on with a line."""
    depth4 = F.when(F.col("p_partkey") % 3 != 0,
                    F.concat(F.lit("L4-"), (F.col("p_partkey") % 7).cast("string")))
    levels = {"cat_l3": ("p_band", F.floor(F.col("p_size") / 10).cast("string")), "cat_l4": ("p_depth4", depth4)}
    return table(spark, folder, "part").withColumns(dict(levels[name] for name in levels if name in need))


def spend_fact(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The spend fact with the given columns (all when none is named).

    The parts are joined before the orders. With one column of theirs the last shuffle is that of the orders or of the
    customers, so lines that a grouping by customer adds up lie together. With several, lines are moved twice only,
    for the parts and for the orders, which have met their customers and nations by then: an order has several lines.
    """
    wanted = list(columns) or FACT_COLUMNS
    need = set(wanted)
    df = _lines(spark, folder)
    if need & _PART:
        df = df.join(_parts(spark, folder, need), F.col("l_partkey") == F.col("p_partkey"), "left")

    def buyers(orders: DataFrame) -> DataFrame:
        if need & _CUSTOMER:
            orders = orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        if need & _NATION:
            orders = orders.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return orders

    if need & _ORDER:
        orders, once = _orders(spark, folder, need), len(need & _PART) > 1
        df = df.join(buyers(orders) if once else orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        df = df if once else buyers(df)
    if need & _SUPPLIER:
        df = df.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    exprs = _expressions()
    return df.select(*[exprs[name].alias(name) for name in wanted])


def event_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """``state, year_month, name, score`` from the event table."""
    step = (F.col("event_id") % 80).cast("int")
    return table(spark, folder, "events").select(
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("state"),
        ((1995 + F.floor(step / 12)) * 100 + step % 12 + 1).cast("int").alias("year_month"),
        F.concat_ws("-", "event_type", "event_id").alias("name"),
        F.least(F.lit(100.0), F.col("value")).alias("score"),
    )


def event_uplift(spark: SparkSession, folder: str) -> DataFrame:
    """``state, year_month, uplift_m`` from the purchase events."""
    step = (F.col("event_id") % 80).cast("int")
    value = F.col("value").cast("decimal(18,4)")
    return (
        table(spark, folder, "events").filter(F.col("event_type") == "purchase")
        .groupBy(
            F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("state"),
            ((1995 + F.floor(step / 12)) * 100 + step % 12 + 1).cast("int").alias("year_month"))
        .agg((F.sum(value).cast("double") / 100).alias("uplift_m"))
    )


def state_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Economic factors per state, built from the customer and supplier tables."""
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    cents = lambda name: F.sum(F.col(name).cast("decimal(18,2)")).cast("double")
    buyers = table(spark, folder, "customer").groupBy("c_nationkey").agg(
        F.count("*").cast("double").alias("population_m"), cents("c_acctbal").alias("gdp_b"))
    sellers = table(spark, folder, "supplier").groupBy("s_nationkey").agg(
        cents("s_acctbal").alias("tourism_b"), F.count("*").cast("double").alias("hotel_count"))
    parts = (
        spend_fact(spark, folder, "state", "category_id").groupBy("state")
        .agg(F.count_distinct("category_id").cast("double").alias("hotel_rooms_k")))
    events = event_calendar(spark, folder).groupBy("state").agg(
        F.count("*").cast("double").alias("event_count"))
    return (
        nation.join(buyers, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(sellers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .join(parts, "state", "left").join(events, "state", "left")
        .select("state", "population_m", "gdp_b", "tourism_b", "hotel_count",
                "hotel_rooms_k", "event_count"))


def segment_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels for every segment but one, so that the fallback is used."""
    segments = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("segment"))
    return (segments.distinct().filter(F.col("segment") != "MACHINERY")
            .select("segment", F.initcap(F.lower("segment")).alias("label")))
