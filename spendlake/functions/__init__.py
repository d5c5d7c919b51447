"""Column helpers. Everything here is a built-in expression, so it stays in codegen."""

from .dates import (
    add_months, month_index, month_label, month_of, parse_year_month, quarter_label,
    season_cos, season_sin, year_of,
)
from .numeric import clamp, coerce_number, digamma, ratio_or_zero, rounded, standard_score, unit_scale
from .text import clean_label, money

__all__ = [
    "add_months", "clamp", "clean_label", "coerce_number", "digamma", "money", "month_index",
    "month_label", "month_of", "parse_year_month", "quarter_label", "ratio_or_zero",
    "rounded", "season_cos", "season_sin", "standard_score", "unit_scale", "year_of",
]
