"""Plans keep the shape that large data needs."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from spendlake.operators import events as ev
from spendlake.sources import star

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "A01_portfolio_month", "A05_two_levels", "A09_summary", "A26_histogram", "F05_unit_scale", "G06_event_spend_detail",
    "J06_mix_alignment", "P12_strategic_class", "P14_high_average", "Q05_over_and_under_index",
    "U03_densify", "W03_pareto", "W09_share_of_total"])
def test_no_cross_join(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_event_ranks_are_cut_before_the_shuffle(spark, folder):
    text = plan(ev.event_scores(star.event_calendar(spark, folder)))
    above, below = text.split("Exchange hashpartitioning", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


def test_scan_is_pruned_and_filtered(spark, folder):
    text = plan(QUERIES["S04_parquet_scan"](spark, folder))
    assert "GreaterThan(l_quantity,25" in text and "l_shipdate" not in text
    month = plan(QUERIES["A08_monthly_total"](spark, folder))
    assert "l_partkey" not in month and "c_custkey" not in month
