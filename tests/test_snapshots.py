"""Marts that refresh themselves."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from spendlake.sources import snapshots

SCHEMA = "k string, spend long, year_month int"


def rows(spark, extra=()):
    base = [(f"k{i % 3}", i, 202401 + i % 4) for i in range(40)]
    return spark.createDataFrame(base + list(extra), SCHEMA)


def build(df):
    return df.groupBy("k", "year_month").agg(F.sum("spend").alias("spend")).select("k", "spend", "year_month")


def whole(spark, path, version=None):
    return sorted(map(tuple, snapshots.read(spark, path, SCHEMA, version).collect()))


def files_of(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_only_changed_months_are_built(spark, tmp_path):
    path, asked = str(tmp_path / "mart"), []

    def watched(df):
        asked.append(sorted(r[0] for r in df.select("year_month").distinct().collect()))
        return build(df)

    assert snapshots.refresh(rows(spark), watched, path) == [202401, 202402, 202403, 202404]
    before = files_of(path)
    assert snapshots.refresh(rows(spark).repartition(5), watched, path) == [] and files_of(path) == before
    more = rows(spark, [("k9", 7, 202403), ("k9", 7, 202405)])
    assert snapshots.refresh(more, watched, path) == [202403, 202405]
    assert asked == [[202401, 202402, 202403, 202404], [202403, 202405]]
    assert whole(spark, path) == sorted(map(tuple, build(more).collect()))
    assert snapshots.refresh(more.filter("year_month <> 202402"), watched, path) == [202402] and len(asked) == 2
    assert whole(spark, path) == sorted(map(tuple, build(more.filter("year_month <> 202402")).collect()))


def test_a_reader_between_two_steps_sees_the_old_mart(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "mart")
    snapshots.refresh(rows(spark), build, path)
    old, reader = whole(spark, path), snapshots.read(spark, path, SCHEMA)
    seen, commit = [], snapshots._commit
    monkeypatch.setattr(snapshots, "_commit", lambda *a: (seen.append(whole(spark, path)), commit(*a)))
    snapshots.refresh(rows(spark, [("new", 1, 202401)]), build, path)
    assert seen == [old] and whole(spark, path) != old
    assert sorted(map(tuple, reader.collect())) == old and whole(spark, path, 1) == old


@pytest.mark.parametrize("step", ["_move", "_commit"])
def test_a_refresh_that_dies_changes_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "mart")
    snapshots.refresh(rows(spark), build, path)
    old, changed = whole(spark, path), rows(spark, [("new", 1, 202404)])
    with monkeypatch.context() as m:
        m.setattr(snapshots, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            snapshots.refresh(changed, build, path)
    assert whole(spark, path) == old
    assert snapshots.refresh(changed, build, path) == [202404]
    assert whole(spark, path) == sorted(map(tuple, build(changed).collect()))


def test_repeated_and_changed_rows_change_the_fingerprint(spark):
    marks = snapshots.fingerprints(rows(spark))
    assert marks == snapshots.fingerprints(rows(spark).orderBy(F.desc("spend")))
    twice = snapshots.fingerprints(rows(spark).unionByName(rows(spark).filter("year_month = 202401")))
    assert [m for m in marks if marks[m] != twice[m]] == [202401]
    assert snapshots.fingerprints(rows(spark, [("x", 1, None)])) == marks


def test_months_without_rows_and_empty_sources(spark, tmp_path):
    path = str(tmp_path / "mart")
    assert snapshots.refresh(rows(spark).filter("false"), build, path) == []
    kept = lambda df: build(df.filter("spend < 0"))
    snapshots.refresh(rows(spark), kept, path)
    assert whole(spark, path) == [] and len(snapshots.manifest(spark, path)) == 4
    assert snapshots.refresh(rows(spark).filter("false"), kept, path) == [202401, 202402, 202403, 202404]


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    path = str(tmp_path / "mart")
    for i in range(4):
        snapshots.refresh(rows(spark, [("x", i, 202401)]), build, path)
    now = whole(spark, path)
    assert snapshots.vacuum(spark, path, keep=1) == [1, 2, 3]
    assert whole(spark, path) == now and snapshots.versions(spark, path) == [4]
    assert sorted(os.listdir(os.path.join(path, "data"))) == ["version=1", "version=4"]


def test_the_query_joins_its_lines_once(spark, folder, monkeypatch):
    """Five passes over the lines read one written table, not five joins."""
    from spendlake.catalog import ENTRIES, files

    made, asked = [], files.fact
    monkeypatch.setattr(files, "fact", lambda *a: made.append(asked(*a)) or made[-1])
    read, seen = snapshots.refresh, []
    monkeypatch.setattr(snapshots, "refresh", lambda df, *a: seen.append(df) or read(df, *a))
    assert ENTRIES["S10_snapshot_refresh"].run(spark, folder).count() > 0
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen]
    assert len(made) == 1 and len(plans) == 3 and not any("Join" in plan for plan in plans)
