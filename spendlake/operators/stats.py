"""Statistics by plain aggregates: correlation, moments, histograms, mutual information."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import standard_score
from ..session import settle
from .clean import known_keys
from .ranking import quantiles


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
    return out


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a Pearson r over n pairs: I(1 - r^2; (n - 2) / 2, 1 / 2)."""
    from math import lgamma

    a = np.maximum((n.to_numpy(float) - 2.0) / 2.0, 1e-9)
    b = np.full_like(a, 0.5)
    x = np.clip(1.0 - r.to_numpy(float) ** 2, 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    log_beta = np.array([lgamma(p + 0.5) - lgamma(p) - lgamma(0.5) for p in a])
    front = np.exp(log_beta + a * np.log(inner) + b * np.log1p(-inner))
    direct = inner < (a + 1.0) / (a + b + 2.0)
    low = front * _beta_fraction(a, b, inner) / a
    high = 1.0 - front * _beta_fraction(b, a, 1.0 - inner) / b
    p = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(direct, low, high)))
    return pd.Series(np.where(n.to_numpy(float) > 2, p, np.nan))


def factor_correlation(df: DataFrame, factors: list[str], target: str = "total_spend") -> DataFrame:
    """Pearson r, r squared and p-value of each factor with the target; constants give null r.

    All factors are unpivoted and correlated in one grouping. r comes from sums of
    squares, because a constant column would raise a division error in ``corr``.
    """
    filled = df.select(
        F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("_y"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in factors])
    long = filled.unpivot(["_y"], factors, "factor", "_x")
    sums = long.groupBy("factor").agg(
        F.regr_sxy("_y", "_x").alias("_sxy"), F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"), F.count("*").alias("n"))
    r = F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy")))
    out = sums.select("factor", "n", r.alias("pearson_r"), (r * r).alias("r_squared"))
    p = F.when(F.col("pearson_r").isNotNull(), correlation_p_value("pearson_r", "n"))
    return out.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


def standardised_regression(df: DataFrame, factors: list[str],
                            target: str = "total_spend") -> DataFrame:
    """Least-squares coefficients on standardised factors. Fits once, over aggregated sums."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    scored = standard_score(df, factors).withColumn(
        "label", F.coalesce(F.col(target).cast("double"), F.lit(0.0)))
    names = [f"{c}_z" for c in factors]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(scored)
    model = LinearRegression(solver="normal", regParam=0.0).fit(ready.select("features", "label"))
    rows = [("intercept", float(model.intercept))]
    rows += [(name, float(c)) for name, c in zip(factors, model.coefficients)]
    return df.sparkSession.createDataFrame(rows, "factor string, coefficient double")


def fit_line(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Slope and intercept of the least-squares line."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*(keys or [])).agg(
        F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"))


def residual_moments(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, range, and bias-corrected skew and excess kurtosis.

    Spark's skewness and kurtosis are population moments; they are rescaled by n.
    """
    x = F.col(value).cast("double")
    raw = df.groupBy(*(keys or [])).agg(
        F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
    n = F.col("n")
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * F.col("_g2") + 6), (n - 2) * (n - 3)))
    return raw.withColumns({"skew": skew, "kurtosis": kurt}).drop("_g1", "_g2")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over the range, the last one closed; empty bins are absent."""
    x = F.col(value).cast("double")
    low, high = df.select(F.min(x)).scalar(), df.select(F.max(x)).scalar()
    width = (high - low) / bins
    slot = F.coalesce(F.floor(F.try_divide(x - low, width)), F.lit(0))
    return (df.filter(x.isNotNull()).groupBy(F.least(slot, F.lit(bins - 1)).cast("int").alias("bin"))
            .agg(F.count("*").alias("n")))


def box_numbers(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 quartile ranges, and outlier count per key."""
    quarter = quantiles(df, [key], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    spread = (F.col("q75") - F.col("q25")) * 1.5
    x = F.col(value).cast("double")
    joined = df.join(settle(quarter), key).withColumn(
        "_in", x.between(F.col("q25") - spread, F.col("q75") + spread))
    return joined.groupBy(key, "q25", "q50", "q75").agg(
        F.min(F.when(F.col("_in"), x)).alias("whisker_low"),
        F.max(F.when(F.col("_in"), x)).alias("whisker_high"),
        F.count_if(~F.col("_in")).alias("outliers"))


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Binned mutual information, in nats, of each feature with the target.

    Feature values are taken as they are; the target is cut into bins of equal frequency
    at its exact quantiles. One contingency grouping covers all features.
    """
    cuts = {f"c{i}": i / bins for i in range(1, bins)}
    edges = quantiles(df, [], target, cuts).select(F.array(*cuts)).scalar()
    y = F.col(target).cast("double")
    below = [(F.get("_edges", F.lit(i)) < y).cast("int") for i in range(bins - 1)]
    labelled = df.withColumn("_edges", edges).withColumn("_y", reduce(add, below))
    text = labelled.select("_y", *[F.col(c).cast("string").alias(c) for c in features])
    long = text.unpivot(["_y"], features, "feature", "_x")
    cells = settle(long.groupBy("feature", "_x", "_y")
                   .agg(F.count("*").alias("_n")))
    per_x = cells.groupBy("feature", "_x").agg(F.sum("_n").alias("_nx"))
    per_y = cells.groupBy("feature", "_y").agg(F.sum("_n").alias("_ny"))
    n = cells.filter(F.col("feature") == features[0]).select(F.sum("_n")).scalar()
    per_x = per_x.withColumnsRenamed({"feature": "_f", "_x": "_v"})
    same = (F.col("feature") == F.col("_f")) & F.col("_x").eqNullSafe(F.col("_v"))  # a missing value is one too
    joined = cells.join(per_x, same).join(per_y, ["feature", "_y"])
    p = F.col("_n") / n
    term = p * F.log(F.col("_n") * n / (F.col("_nx") * F.col("_ny")))
    return joined.groupBy("feature").agg(F.sum(term).alias("mutual_information")).withColumn(
        "estimator", F.lit(f"binned, {bins} equal-frequency target bins"))


def basket_similarity(fact: DataFrame, key: str = "customer_id", group: str = "segment",
                      item: str = "cat_l2", support: float = 0.5) -> DataFrame:
    """Jaccard similarity of each key's basket to the nearest group centroid basket.

    A centroid holds the items bought by at least ``support`` of a group's keys. Baskets
    stay rows: |A n C| is counted by an equi-join on the item, never by a set per key.
    The distinct rows are settled, since four branches read them.
    """
    items = settle(known_keys(fact, [key, group, item]).select(key, group, item).distinct())
    members = items.groupBy(group).agg(F.count_distinct(key).alias("_keys"))
    centroid = (items.groupBy(group, item).agg(F.count("*").alias("_buyers"))
                .join(members, group).filter(F.col("_buyers") >= F.col("_keys") * support)
                .select(F.col(group).alias("centroid"), item))
    centroid_size = centroid.groupBy("centroid").agg(F.count("*").alias("_c"))
    basket = items.select(key, item).distinct()
    basket_size = basket.groupBy(key).agg(F.count("*").alias("_a"))
    shared = (basket.join(centroid, item).groupBy(key, "centroid")
              .agg(F.count("*").alias("_both")))
    scored = (shared.join(basket_size, key).join(centroid_size, "centroid")
              .withColumn("jaccard", F.col("_both") / (F.col("_a") + F.col("_c") - F.col("_both"))))
    best = scored.groupBy(key).agg(F.max("jaccard").alias("jaccard"))
    return basket_size.select(key).join(best, key, "left").fillna({"jaccard": 0.0})


def scores(df: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """R squared, mean absolute error and root mean squared error, in one pass."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    raw = df.groupBy(*(keys or [])).agg(
        F.sum((y - p) * (y - p)).alias("_rss"), (F.var_pop(y) * F.count(y)).alias("_tss"),
        F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"))
    r2 = F.lit(1.0) - F.try_divide(F.col("_rss"), F.col("_tss"))
    return raw.select(*(keys or []), r2.alias("r2"), "mae", "rmse")
