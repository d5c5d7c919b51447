"""Month-grained marts from the spend fact."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ranking, rollup, trend
from ..operators.clean import known_keys, only_members
from ..sources import files

PRICES = ["spend", "list_price", "savings"]


def portfolio_month(detail: DataFrame) -> DataFrame:
    return rollup.month_rollup(detail, [], PRICES, {
        "locations": "customer_id", "clients": "client_id", "categories": "cat_l1"})


def segment_month(detail: DataFrame) -> DataFrame:
    return rollup.month_rollup(detail, ["segment"], PRICES, {
        "locations": "customer_id", "clients": "client_id", "categories": "cat_l1"})


def category_month(detail: DataFrame) -> DataFrame:
    return rollup.month_rollup(detail, ["cat_l1"], PRICES, {
        "locations": "customer_id", "segments": "segment"})


def state_month(detail: DataFrame, states: list[str] | DataFrame | None = None) -> DataFrame:
    kept = detail if states is None else only_members(detail, "state", states)
    return rollup.month_rollup(kept, ["state"], ["spend"], {
        "locations": "customer_id", "clients": "client_id"})


def segment_state_month(fact: DataFrame) -> DataFrame:
    return fact.dropna(subset=["segment", "state"]).groupBy("segment", "state", "year_month").agg(
        F.sum("spend").alias("spend"))


def segment_features(seg_month: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """One row per segment: totals over present months, trend over all months, classes."""
    months = trend.known_months(seg_month)
    dense = trend.densify(seg_month, ["segment"], months=months)
    features = trend.trend_features(dense, ["segment"]).withColumnRenamed("n", "months")
    joined = rollup.segment_totals(seg_month).join(features, "segment")
    joined = joined.withColumn("avg_monthly_spend",
                               F.col("total_spend").cast("double") / F.col("months"))
    if customers is not None:
        share = rollup.ecomm_penetration(customers).select("segment", "ecomm_penetration")
        joined = joined.join(share, "segment", "left").fillna({"ecomm_penetration": 0.0})
    return trend.strategic_class(joined).withColumn("growth_signal", trend.growth_signal())


def customer_summary(fact: DataFrame) -> DataFrame:
    """One row per customer; one active line makes the customer active."""
    active = F.max((F.upper("ecomm_status") == "ACTIVE").cast("int"))
    return fact.dropna(subset=["customer_id"]).groupBy("customer_id").agg(
        F.min("segment").alias("segment"),
        F.when(active == 1, "ACTIVE").otherwise(F.max("ecomm_status")).alias("ecomm"),
        F.sum("spend").alias("total_spend"))


def client_concentration(detail: DataFrame) -> DataFrame:
    clients = known_keys(detail, ["client_id"]).groupBy("client_id").agg(F.sum("spend").alias("total_spend"))
    return ranking.pareto(clients, "client_id")


def build(fact: DataFrame, folder: str, months: list[int] | None = None) -> None:
    """Write every mart under ``folder``; with ``months`` refresh only these months.

    The customer-month detail is written first and read back: every other mart is a
    rollup of the small table instead of another pass over the fact.
    """
    spark: SparkSession = fact.sparkSession
    source = fact if months is None else fact.filter(F.col("year_month").isin(months))
    detail_path = os.path.join(folder, "customer_month")
    files.write_mart(rollup.customer_month(source), detail_path, months=months)
    detail = files.read_mart(spark, detail_path)
    fresh = detail if months is None else detail.filter(F.col("year_month").isin(months))
    for name, frame in (("portfolio_month", portfolio_month), ("segment_month", segment_month),
                        ("category_month", category_month), ("state_month", state_month),
                        ("segment_state_month", segment_state_month)):
        files.write_mart(frame(fresh), os.path.join(folder, name), months=months)
    whole = files.read_mart(spark, os.path.join(folder, "segment_month"))
    files.write_mart(segment_features(whole), os.path.join(folder, "segment_features"), by_month=False)
    files.write_mart(client_concentration(detail), os.path.join(folder, "concentration"), by_month=False)
