"""Months as ``yyyyMM`` integers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_year_month(col: Column | str) -> Column:
    """Read ``202501``, ``2025-01`` or ``202501.0``; anything else is null."""
    text = F.trim(_as_col(col).cast("string"))
    plain = F.regexp_extract(text, r"^(\d{4})-?(0[1-9]|1[0-2])(\.0+)?$", 1)
    month = F.regexp_extract(text, r"^(\d{4})-?(0[1-9]|1[0-2])(\.0+)?$", 2)
    return F.concat(plain, month).try_cast("int")


def month_of(ym: Column | str) -> Column:
    return (_as_col(ym) % 100).cast("int")


def year_of(ym: Column | str) -> Column:
    return F.floor(_as_col(ym) / 100).cast("int")


def month_index(ym: Column | str) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    return (year_of(ym) * 12 + month_of(ym) - 1).cast("int")


def add_months(ym: Column | str, months: int | Column) -> Column:
    moved = month_index(ym) + months
    return (F.floor(moved / 12) * 100 + moved % 12 + 1).cast("int")


def month_label(ym: Column | str) -> Column:
    """``202501`` -> ``2025 Jan``."""
    return F.date_format(F.make_date(year_of(ym), month_of(ym), F.lit(1)), "yyyy MMM")


def quarter_label(ym: Column | str) -> Column:
    """``202504`` -> ``Q2 2025``."""
    quarter = F.floor((month_of(ym) + 2) / 3).cast("int")
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year_of(ym).cast("string"))


def season_sin(ym: Column | str) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * month_of(ym) / 12)


def season_cos(ym: Column | str) -> Column:
    return F.cos(F.lit(2.0) * F.pi() * month_of(ym) / 12)
