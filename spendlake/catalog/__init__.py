"""Registered queries, each with the SQL it is checked against where SQL can say it."""

from .base import ENTRIES, Entry

from . import compare, files, learning, rollups, shape, statistics, windows  # noqa: F401,E402

__all__ = ["ENTRIES", "Entry"]
