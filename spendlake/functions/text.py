"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def money(col: Column | str, digits: int = 2) -> Column:
    """Short dollar text: ``$1.25B``, ``$3.40M``, ``$7.5K``, ``$912``; null gives a dash."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    size = F.abs(value)
    scaled = f"$%.{digits}f"
    return (
        F.when(value.isNull(), F.lit("—"))
        .when(size >= 1e9, F.format_string(scaled + "B", value / 1e9))
        .when(size >= 1e6, F.format_string(scaled + "M", value / 1e6))
        .when(size >= 1e3, F.format_string("$%.1fK", value / 1e3))
        .otherwise(F.format_string("$%.0f", value))
    )


def clean_label(col: Column | str) -> Column:
    """Feature name for display: no ``_enc`` suffix, blanks for underscores, title case."""
    name = F.col(col) if isinstance(col, str) else col
    return F.initcap(F.replace(F.replace(name, F.lit("_enc"), F.lit("")), F.lit("_"), F.lit(" ")))
