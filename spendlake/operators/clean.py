"""Cleaning, flags and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import coerce_number
from ..schema import CATEGORY_LEVELS, UNKNOWN


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column to double, unreadable and null to 0."""
    return df.withColumns({name: coerce_number(name) for name in columns})


def positive_spend(df: DataFrame, spend: str = "spend") -> DataFrame:
    """Rows with a known spend above zero."""
    return df.filter(F.col(spend).isNotNull() & (F.col(spend) > 0))


def fill_unknown(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(UNKNOWN, subset=columns)


def known_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows with a null key: groupings count only known keys."""
    return df.dropna(subset=keys)


def category_depth(levels: list[str] = CATEGORY_LEVELS) -> Column:
    """How many category levels are filled."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in levels])


def purchase_flags(df: DataFrame) -> DataFrame:
    """``has_rooms``, ``room_count`` and ``is_ecomm_active``."""
    return df.withColumns({
        "has_rooms": F.col("rooms").isNotNull().cast("int"),
        "room_count": coerce_number("rooms"),
        "is_ecomm_active": F.coalesce((F.lower("ecomm_status") == "active").cast("int"), F.lit(0)),
    })


def months_between(df: DataFrame, first: int, last: int) -> DataFrame:
    """Inclusive month range; prunes partitions of a month-grained mart."""
    return df.filter(F.col("year_month").between(first, last))


def only_members(df: DataFrame, column: str, members: list | DataFrame) -> DataFrame:
    """Keep rows whose value is in a list, or in a one-column frame."""
    if isinstance(members, DataFrame):
        keys = members.toDF(column).distinct()
        return df.join(keys, column, "left_semi")
    return df.filter(F.col(column).isin(members))


def above_row_max(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """Rows whose largest value over the columns exceeds the threshold."""
    return df.filter(F.greatest(*columns) > threshold)


def with_label(df: DataFrame, labels: DataFrame, key: str = "segment") -> DataFrame:
    """Add ``label``, falling back to the key itself."""
    return df.join(labels, key, "left").withColumn("label", F.coalesce("label", key))


def with_defaults(df: DataFrame, lookup: DataFrame, keys: list[str],
                  defaults: dict[str, float]) -> DataFrame:
    """Left lookup where a missing row or value takes the default."""
    wanted = lookup.select(*keys, *defaults)
    return df.join(wanted, keys, "left").fillna(defaults)


def per_unit(df: DataFrame, spend: str = "total_spend") -> DataFrame:
    """Spend per head (population in millions) and per room (rooms in thousands)."""
    return df.withColumns({
        "spend_per_capita": F.try_divide(F.col(spend).cast("double"), F.col("population_m") * 1e6),
        "spend_per_hotel_room": F.try_divide(F.col(spend).cast("double"),
                                             F.col("hotel_rooms_k") * 1e3),
    })


def far_above_mean(df: DataFrame, value: str, times: float = 2.0) -> DataFrame:
    """Rows whose value exceeds a multiple of the column's mean."""
    return df.filter(F.col(value) > df.select(F.avg(value)).scalar() * times)


def with_event_list(df: DataFrame, events: str = "events") -> DataFrame:
    """An array column as display text and as a count."""
    return df.withColumns({"major_events": F.concat_ws("; ", events),
                           "event_count": F.coalesce(F.size(events), F.lit(0))})
