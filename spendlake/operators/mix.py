"""Shares of a total and category mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ratio_or_zero
from .clean import known_keys


def with_share(df: DataFrame, value: str, within: list[str] | None = None,
               name: str = "share_pct") -> DataFrame:
    """Percent of the total, over all rows or within keys.

    The overall total is a scalar subquery; totals within keys are joined, so that a hot
    key is not gathered in one window task.
    """
    if not within:
        total = df.select(F.sum(value)).scalar()
        return df.withColumn(name, ratio_or_zero(F.col(value) * 100, total))
    totals = df.groupBy(*within).agg(F.sum(value).alias("_total"))
    return (df.join(totals, within)
            .withColumn(name, ratio_or_zero(F.col(value) * 100, F.col("_total")))
            .drop("_total"))


def category_mix(fact: DataFrame, key: str = "segment", category: str = "cat_l1",
                 value: str = "spend") -> DataFrame:
    """Spend and share of each category within a key."""
    cells = (known_keys(fact, [key, category]).groupBy(key, category)
             .agg(F.sum(value).alias("total_spend")))
    return with_share(cells, "total_spend", [key], "pct")


def national_mix(fact: DataFrame, category: str = "cat_l1", value: str = "spend") -> DataFrame:
    """Share of each category in all spend."""
    cells = known_keys(fact, [category]).groupBy(category).agg(F.sum(value).alias("total_spend"))
    return with_share(cells, "total_spend", name="pct")


def mix_against_national(segment_mix: DataFrame, national: DataFrame, key: str = "segment",
                         category: str = "cat_l1") -> DataFrame:
    """Every key against every national category; a missing share is 0.

    The spine explodes the array of national categories per key: no join of all pairs.
    """
    categories = national.select(F.sort_array(F.collect_set(category))).scalar()
    spine = (segment_mix.select(key).distinct()
             .select(key, F.explode(categories).alias(category)))
    mine = segment_mix.select(key, category, F.col("pct").alias("segment_pct"))
    base = national.select(category, F.col("pct").alias("national_pct"))
    zero = F.lit(0.0)
    return (spine.join(mine, [key, category], "left").join(base, category, "left")
            .select(key, category, F.coalesce("segment_pct", zero).alias("segment_pct"),
                    F.coalesce("national_pct", zero).alias("national_pct"))
            .withColumn("delta_pp", F.col("segment_pct") - F.col("national_pct")))
