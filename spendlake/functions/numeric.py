"""Numeric helpers that do not raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TINY = 1e-9  # fixed value: guards the reference quotients


def coerce_number(col: Column | str) -> Column:
    """Text to double; anything unreadable, and null, becomes 0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the quotient does not exist."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def clamp(value: Column, floor: Column, ceiling: Column) -> Column:
    """Bound a value; the floor wins where it lies above the ceiling. Null stays null."""
    bounded = F.greatest(floor, F.least(ceiling, value))
    return F.when(value.isNotNull() & floor.isNotNull() & ceiling.isNotNull(), bounded)


def rounded(col: Column, digits: int = 6) -> Column:
    """Round a double; adding zero turns -0.0 into 0.0."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def unit_scale(df: DataFrame, columns: list[str], epsilon: float = 0.0) -> DataFrame:
    """Min-max scale each column to 0..1 as ``<name>_scaled``; a constant column gives null.

    The bounds are scalar subqueries: no window over the whole frame, no join.
    """
    out = []
    for name in columns:
        low = df.select(F.min(name)).scalar().cast("double")
        high = df.select(F.max(name)).scalar().cast("double")
        span = high - low + F.lit(epsilon)
        out.append(F.try_divide(F.col(name).cast("double") - low, span).alias(f"{name}_scaled"))
    return df.select("*", *out)


def standard_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(x - mean) / (population std + 1e-9)`` per column as ``<name>_z``; null counts as 0."""
    out = []
    for name in columns:
        filled = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        mean = df.select(F.avg(filled)).scalar()
        deviation = df.select(F.stddev_pop(filled)).scalar()
        out.append(((filled - mean) / (deviation + F.lit(TINY))).alias(f"{name}_z"))
    return df.select("*", *out)


def digamma(n: Column) -> Column:
    """The logarithmic derivative of the gamma function for positive numbers, to about 1e-12.

    Ten steps of the recurrence lead to where the asymptotic series is short.
    """
    x = n.cast("double")
    far = x + 10
    square = 1 / (far * far)
    tail = square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    steps = x - x
    for i in range(10):
        steps = steps + 1 / (x + i)
    return F.log(far) - 0.5 / far - tail - steps
