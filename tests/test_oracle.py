"""Every query that SQL can express equals its SQL on the small tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows_of

SQL = entry.oracle_sql()
QUERIES = entry.queries()


#: Fits for minutes with its full settings; ``test_outlook_invariants`` runs it with small ones.
LONG = {"M22_outlook_invariants"}


@pytest.fixture(scope="module")
def results(spark, folder):
    """All queries, four at a time: at this size each one is mostly waiting."""
    def run(name):
        df = QUERIES[name](spark, folder)
        return rows_of(df.columns, [tuple(row) for row in df.collect()])

    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in sorted(set(SQL) - LONG)}


@pytest.mark.parametrize("name", sorted(set(SQL) - LONG))
def test_matches_sql(results, db, name):
    columns, got = results[name].result()
    result = db.execute(SQL[name])
    wanted_columns, wanted = rows_of([d[0] for d in result.description], result.fetchall())
    assert columns == wanted_columns
    assert got == wanted


def test_outlook_invariants(spark, folder, db, monkeypatch):
    from spendlake.catalog import learning

    full = learning.fc.state_learners
    monkeypatch.setattr(learning.fc, "state_learners", lambda rounds=2, trees=2: full(2, 2))
    monkeypatch.setattr(learning, "_OUTLOOKS", {})
    columns, got = rows_of(*(lambda df: (df.columns, [tuple(r) for r in df.collect()]))(QUERIES["M22_outlook_invariants"](spark, folder)))
    result = db.execute(SQL["M22_outlook_invariants"])
    assert (columns, got) == rows_of([d[0] for d in result.description], result.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
