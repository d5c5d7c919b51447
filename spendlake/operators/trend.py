"""Monthly series: densifying, trend features, classes, active rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ratio_or_zero
from .clean import known_keys


def known_months(df: DataFrame, month: str = "year_month") -> Column:
    """Sorted array of the months in a frame, as a scalar subquery. Bounded by the calendar."""
    return df.select(F.sort_array(F.collect_set(month))).scalar()


def densify(df: DataFrame, keys: list[str], value: str = "spend", month: str = "year_month",
            months: Column | None = None) -> DataFrame:
    """One row per key and month, missing months 0."""
    months = known_months(df, month) if months is None else months
    spine = known_keys(df, keys).select(*keys).distinct().select(
        *keys, F.posexplode(months).alias("month_no", month))
    return (spine.join(df.select(*keys, month, value), [*keys, month], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(0))))


def trend_features(dense: DataFrame, keys: list[str], value: str = "spend",
                   position: str = "month_no") -> DataFrame:
    """Trend measures of a dense series, by plain aggregates after one shuffle.

    ``position`` counts months from 0. A series of fewer than two months has only its
    level; a constant one has r2 0.
    """
    y = F.col(value).cast("double")
    x = F.col(position).cast("double")
    series = W.partitionBy(*keys)  # bounded by the calendar, and the grouping reuses its shuffle
    sized = dense.withColumns({
        "n": F.count("*").over(series), "_last": F.max(position).over(series)})
    ahead = F.col(position) < 3
    behind = F.col(position) > F.col("_last") - 3
    early = F.struct(F.col(value), -F.col(position))
    raw = sized.groupBy(*keys, "n").agg(
        F.regr_slope(y, x).alias("_slope"), F.regr_r2(y, x).alias("_r2"),
        F.var_pop(y).alias("_var"), F.avg(y).alias("_mean"),
        F.avg(F.when(ahead, y)).alias("q1_avg"), F.avg(F.when(behind, y)).alias("q4_avg"),
        F.max_by(position, early).alias("_best"),
        F.min_by(position, F.struct(F.col(value), F.col(position))).alias("_worst"))
    short = F.col("n") < 2
    zero = F.lit(0.0)
    guard = lambda c: F.when(F.col(c) == 0, F.lit(1e-9)).otherwise(F.col(c))
    pick = lambda c: F.when(short, zero).otherwise(c)
    return raw.select(
        *keys, "n",
        pick(F.col("_slope")).alias("slope"),
        pick(F.col("_slope") / guard("_mean")).alias("slope_norm"),
        pick(F.when(F.col("_var") == 0, zero).otherwise(F.col("_r2"))).alias("r2"),
        pick((F.col("q4_avg") - F.col("q1_avg")) / guard("q1_avg")).alias("momentum"),
        pick(F.sqrt("_var") / guard("_mean")).alias("volatility"),
        "q1_avg", "q4_avg",
        F.when(short, 0).otherwise(F.col("_best")).cast("int").alias("best_month"),
        F.when(short, 0).otherwise(F.col("_worst")).cast("int").alias("worst_month"))


def strategic_class(df: DataFrame, total: str = "total_spend",
                    momentum: str = "momentum") -> DataFrame:
    """Two-by-two class: spend against the median, momentum against zero.

    The total must not depend on summing order (a decimal, or a settled frame): the row
    that is the median has to equal it.
    """
    middle = df.select(F.median(total)).scalar()
    big = F.col(total).cast("double") >= middle
    grows = F.col(momentum) > 0
    label = (F.when(big & grows, "Protect & Grow").when(~big & grows, "Emerging Opportunity")
             .when(big, "Revenue at Risk").otherwise("Monitor"))
    return df.withColumn("strategic_class", label)


def growth_signal(momentum: str = "momentum", band: float = 0.05) -> Column:
    col = F.col(momentum)
    return (F.when(col > band, "Growing").when(col < -band, "Declining").otherwise("Stable"))


def risk_quadrant(df: DataFrame, slope: str = "slope", held: str = "concentration") -> DataFrame:
    """Quadrant by trend sign and concentration above the median of a settled frame."""
    dense = F.col(held) >= df.select(F.median(held)).scalar()
    falls = F.col(slope) < 0
    label = (F.when(dense & falls, "High risk").when(dense, "Star")
             .when(falls, "Monitor").otherwise("Stable"))
    return df.withColumn("risk_class", label)


def worth_a_note(df: DataFrame, slope: str = "slope", held: str = "concentration") -> DataFrame:
    """Rows whose slope or concentration stands out."""
    steep = df.select(F.percentile(F.abs(slope), F.lit(0.65))).scalar()
    high = df.select(F.percentile(F.col(held), F.lit(0.8))).scalar()
    return df.filter((F.abs(slope) > steep) | (F.col(held) > high))


def active_rate(dense: DataFrame, keys: list[str], value: str = "spend",
                months: int = 12, position: str = "month_no") -> DataFrame:
    """Share of the last months that lie above the series' own median over those months.

    A series has one row per month, so its window is bounded by the calendar.
    """
    last = dense.select(F.max(position)).scalar()
    recent = dense.filter(F.col(position) > last - months)
    x = F.col(value).cast("double")
    middle = recent.groupBy(*keys).agg(F.median(x).alias("_median"))
    above = F.when(x > F.col("_median"), 1.0).otherwise(0.0)
    return recent.join(middle, keys).groupBy(*keys).agg(F.avg(above).alias("active_rate"))


def edge_means(df: DataFrame, keys: list[str], value: str = "spend", n: int = 3,
               month: str = "year_month") -> DataFrame:
    """Means of the first and the last n months of each series."""
    first = W.partitionBy(*keys).orderBy(month)
    last = W.partitionBy(*keys).orderBy(F.desc(month))
    placed = df.withColumns({"_a": F.row_number().over(first), "_z": F.row_number().over(last)})
    x = F.col(value).cast("double")
    return placed.groupBy(*keys).agg(
        F.avg(F.when(F.col("_a") <= n, x)).alias("first_avg"),
        F.avg(F.when(F.col("_z") <= n, x)).alias("last_avg"))


def step_delta(df: DataFrame, order: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Change against the step before; the first step has 0."""
    window = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy(order)
    change = F.col(value) - F.lag(value).over(window)
    return df.withColumn("delta", F.coalesce(change, F.lit(0.0)))


def quarter_change(df: DataFrame, keys: list[str], order: str = "quarter_no",
                   value: str = "spend") -> DataFrame:
    """Percent change against the quarter before; blank for the first and a zero base."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order)).cast("double")
    change = F.try_divide(F.col(value).cast("double") - before, before) * 100
    return df.withColumn("qoq_pct", change)


def growth_pct(now: Column, before: Column) -> Column:
    """Percent growth, 0 for a zero base."""
    return ratio_or_zero((now - before) * 100, before)
