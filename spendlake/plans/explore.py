"""The exploratory report: one frame per metric."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..operators import mix, ranking, rollup
from ..operators.clean import positive_spend
from ..sources import files


def report(fact: DataFrame) -> dict[str, DataFrame]:
    """Metric name -> frame. All are lazy but the ranked ones, which settle their order."""
    df = positive_spend(fact)
    by_customer = df.groupBy("customer_id").agg(F.sum("spend").alias("total_spend"))
    eco = rollup.key_stats(df, "ecomm_status").join(
        ranking.quantiles(df, ["ecomm_status"], "spend", {"median_spend": 0.5}), "ecomm_status")
    return {
        "spend_stats": ranking.summary(df, []),
        "segment_spend": rollup.key_stats(df, "segment").orderBy(F.desc("total_spend"), "segment"),
        "category_spend": rollup.key_stats(df, "cat_l1").orderBy(F.desc("total_spend"), "cat_l1"),
        "entity_spend": rollup.key_stats(df, "entity_type").orderBy(F.desc("total_spend"), "entity_type"),
        "monthly_trend": df.groupBy("year_month").agg(F.sum("spend").alias("spend")),
        "state_spend": rollup.key_stats(df, "state").orderBy(F.desc("total_spend"), "state"),
        "pareto": ranking.concentration(by_customer, "customer_id"),
        "category_concentration": mix.national_mix(df),
        "ecommerce_impact": eco,
    }


def write(fact: DataFrame, folder: str) -> None:
    for name, frame in report(fact).items():
        files.write_report(frame, os.path.join(folder, name))
