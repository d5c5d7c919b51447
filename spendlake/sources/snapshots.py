"""A mart that refreshes itself: only the months whose source rows have changed, and all at once for readers.

Under the mart's folder, ``data/version=n`` holds the months that the n-th refresh built, and
``manifest-n`` lists, for every month, the version that holds it and the fingerprint of the rows it was
built from. A manifest is written beside its place and then renamed, and never changed; the one of the
greatest number is the mart. So a reader sees the mart before a refresh or after it, also
while data is being written, and a refresh that dies leaves nothing that is read.

Rows without a month belong to no month and are left out. Versions that no manifest to come will
name stay for readers that still use them, until ``vacuum``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MONTH = "year_month"
ENTRY = "month int, fingerprint string, version int, filled boolean"


@dataclass(frozen=True)
class Entry:
    fingerprint: str
    version: int
    #: Whether the month has rows in the mart; a month may have none that the mart keeps.
    filled: bool


def fingerprints(fact: DataFrame) -> dict[int, str]:
    """Per month, its number of rows and two sums of row hashes: the same whatever the order of rows."""
    columns = [F.col(f"`{c}`") for c in sorted(fact.columns)]
    digest = lambda *seed: F.sum(F.xxhash64(*map(F.lit, seed), *columns).cast("decimal(38,0)")).cast("string")
    rows = fact.filter(F.col(MONTH).isNotNull()).groupBy(F.col(MONTH).cast("int").alias("month")).agg(
        F.concat_ws("/", F.count("*").cast("string"), digest(), digest("again")).alias("f"))
    return {row["month"]: row["f"] for row in rows.collect()}  # a row a month


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, lead: str) -> list[int]:
    place, system = _files(spark, path)
    if not system.exists(place):
        return []
    ends = [status.getPath().getName().removeprefix(lead) for status in system.listStatus(place)]
    return sorted(int(end) for end in ends if end.isdecimal())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that are in place, rising."""
    return _numbers(spark, path, "manifest-")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[int, Entry]:
    """The months of the mart as it is now, or as a version made it."""
    found = versions(spark, path) if version is None else [version]
    if not found:
        return {}
    rows = spark.read.schema(ENTRY).json(f"{path}/manifest-{found[-1]}").collect()  # a row a month
    return {row["month"]: Entry(row["fingerprint"], row["version"], row["filled"]) for row in rows}


def refresh(fact: DataFrame, build: Callable[[DataFrame], DataFrame], path: str) -> list[int]:
    """Builds the months whose rows have changed, takes out those that are gone, and returns both.

    ``build`` makes the mart's rows, with ``year_month``, from rows of whole months.
    """
    spark = fact.sparkSession
    before, now = manifest(spark, path), fingerprints(fact)
    changed = [month for month, mark in now.items() if month not in before or before[month].fingerprint != mark]
    gone = [month for month in before if month not in now]
    if not changed and not gone:
        return []
    # A refresh that died may have left data without a manifest; its number is not used again.
    version = max(versions(spark, path) + _numbers(spark, f"{path}/data", "version="), default=0) + 1
    filled: set[int] = set()
    if changed:
        made = build(fact.filter(F.col(MONTH).isin(changed)))
        data = f"{path}/data/version={version}-{uuid.uuid4().hex}"  # what an earlier attempt left is not met
        made.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(data)
        _move(spark, data, f"{path}/data/version={version}")
        filled = set(_numbers(spark, f"{path}/data/version={version}", f"{MONTH}="))  # a folder a month with rows
    after = {month: Entry(mark, version, month in filled) if month in changed else before[month] for month, mark in now.items()}
    _commit(spark, path, version, after)
    return sorted(changed + gone)


def _move(spark: SparkSession, source: str, target: str) -> None:
    place, system = _files(spark, target)
    if system.exists(place):
        raise RuntimeError(f"{target} is there already: two refreshes at the same time")
    if not system.rename(_files(spark, source)[0], place):
        raise RuntimeError(f"{source} could not be renamed")


def _commit(spark: SparkSession, path: str, version: int, entries: dict[int, Entry]) -> None:
    rows = [(month, e.fingerprint, e.version, e.filled) for month, e in sorted(entries.items())]
    beside = f"{path}/data/_manifest-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.json(beside)
    _move(spark, beside, f"{path}/manifest-{version}")


def read(spark: SparkSession, path: str, schema: T.StructType | str, version: int | None = None) -> DataFrame:
    """The mart as one manifest lists it. ``schema`` is that of the mart, with ``year_month``."""
    entries = manifest(spark, path, version)
    folders = [f"{path}/data/version={e.version}/{MONTH}={month}" for month, e in sorted(entries.items()) if e.filled]
    if not folders:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([], schema).columns
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*names)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Removes manifests but the last ``keep``, and data that none of these name. Returns the versions removed."""
    found = versions(spark, path)
    if not found:
        return []
    kept = found[-keep:]
    used = {e.version for version in kept for e in manifest(spark, path, version).values()}
    gone = [version for version in found if version not in kept]
    for version in gone:
        place, system = _files(spark, f"{path}/manifest-{version}")
        system.delete(place, True)
    for version in _numbers(spark, f"{path}/data", "version="):
        if version not in used and version <= found[-1]:
            place, system = _files(spark, f"{path}/data/version={version}")
            system.delete(place, True)
    return gone
