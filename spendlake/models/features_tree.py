"""Clustering by mergeable clustering features: count, sum and sum of squares of the rows near a point.

Each task reads its rows once. A row joins the nearest feature if the feature's radius then stays
within the threshold, else it begins one of its own. When there are more than ``ENTRIES``, the
threshold grows and the features are put into a new list by the same rule, as if they were rows. So
a task holds a bounded number, whatever it reads. Lists of tasks are merged in groups of ``MERGE`` by the
same rule, until one is left; sums only ever add up, so its totals are those of the rows. This is
the leaf level of a clustering-feature tree; with at most ``ENTRIES`` leaves, upper levels would save
no search worth having.

The features that remain are then joined, two at a time, by the least growth of the sum of squares,
down to the clusters asked for. A row belongs to the cluster of its nearest feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path

#: Most features in a list, lists merged by one task, and the first threshold on a radius.
ENTRIES, MERGE, THRESHOLD = 400, 8, 0.05
GROW = 1.3
SCHEMA = "part long, threshold double, n array<double>, total array<array<double>>, square array<double>"


@dataclass
class Features:
    """``n`` rows, their ``total`` and the ``square`` of their lengths, one entry for each feature."""

    threshold: float
    n: np.ndarray
    total: np.ndarray
    square: np.ndarray

    @staticmethod
    def none(width: int, threshold: float = THRESHOLD) -> Features:
        return Features(threshold, np.zeros(0), np.zeros((0, width)), np.zeros(0))

    @staticmethod
    def of_rows(rows: np.ndarray, threshold: float = THRESHOLD) -> Features:
        return Features(threshold, np.ones(len(rows)), rows, (rows ** 2).sum(axis=1))

    def added(self, other: Features, entries: int = ENTRIES) -> Features:
        """Both together, in at most ``entries`` features."""
        threshold = max(self.threshold, other.threshold)
        made = self if self.threshold == threshold else _put(Features.none(self.total.shape[1], threshold), self, threshold, entries)
        return _put(made, other, threshold, entries)


def _put(into: Features, new: Features, threshold: float, entries: int) -> Features:
    n, total, square = list(into.n), list(into.total), list(into.square)
    centres = np.zeros((max(entries + 1, len(n) + 1), new.total.shape[1]))
    for i, (count, add) in enumerate(zip(n, total)):
        centres[i] = add / count
    for count, add, length in zip(new.n, new.total, new.square):
        if n:
            at = int(((centres[:len(n)] - add / count) ** 2).sum(axis=1).argmin())
            both, sums, squares = n[at] + count, total[at] + add, square[at] + length
            if squares / both - ((sums / both) ** 2).sum() <= threshold ** 2:
                n[at], total[at], square[at], centres[at] = both, sums, squares, sums / both
                continue
        n.append(count)
        total.append(add)
        square.append(length)
        centres[len(n) - 1] = add / count
        if len(n) > entries:
            threshold *= GROW
            held = Features(threshold, np.array(n), np.array(total), np.array(square))
            held = _put(Features.none(len(add), threshold), held, threshold, entries)
            threshold, n, total, square = held.threshold, list(held.n), list(held.total), list(held.square)
            for i in range(len(n)):
                centres[i] = total[i] / n[i]
    return Features(threshold, np.array(n), np.array(total).reshape(len(n), new.total.shape[1]), np.array(square))


def _frame(part: int, f: Features) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "threshold": [f.threshold], "n": [f.n.tolist()],
                         "total": [f.total.tolist()], "square": [f.square.tolist()]})


def _features(row) -> Features:
    return Features(float(row.threshold), np.array(row.n, float), np.array([list(t) for t in row.total], float), np.array(row.square, float))


def gather(points: DataFrame, entries: int = ENTRIES, threshold: float = THRESHOLD) -> Features | None:
    """The features of ``x array<double>``, at most ``entries``; none without rows."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if len(batch):
                rows = np.array(batch["x"].tolist(), float)
                held = (held or Features.none(rows.shape[1], threshold)).added(Features.of_rows(rows, threshold), entries)
        if held is not None:
            yield _frame(0, held)

    def merge(lists: pd.DataFrame) -> pd.DataFrame:
        found = [_features(row) for row in lists.itertuples()]
        held = found[0]
        for other in found[1:]:
            held = held.added(other, entries)
        return _frame(int(lists["part"].iloc[0]), held)

    spark, level = points.sparkSession, 0
    lists = points.select("x").mapInPandas(build, SCHEMA).withColumn("part", F.spark_partition_id().cast("long"))
    while True:
        path = scratch_path(spark, f"features-{level}")  # a row a task, written so that no task's work is repeated
        lists.write.parquet(path)
        lists = spark.read.schema(SCHEMA).parquet(path)
        if lists.count() <= 1:
            break
        parts = lists.withColumn("part", F.call_function("div", F.row_number().over(_by_part()) - 1, F.lit(MERGE)))
        lists, level = parts.groupBy("part").applyInPandas(merge, SCHEMA), level + 1
    row = lists.first()
    return None if row is None else _features(row)


def _by_part():
    from pyspark.sql import Window

    return Window.orderBy("part")  # a row a task


def joined(f: Features, clusters: int) -> np.ndarray:
    """The cluster of each feature: those are joined whose union adds least to the sum of squares."""
    n, centre = f.n.copy(), f.total / f.n[:, None]
    group, alive = np.arange(len(n)), np.ones(len(n), bool)
    cost = n[:, None] * n[None, :] / (n[:, None] + n[None, :]) * ((centre[:, None] - centre[None, :]) ** 2).sum(axis=2)
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(n) - clusters):
        a, b = np.unravel_index(cost.argmin(), cost.shape)
        centre[a] = (n[a] * centre[a] + n[b] * centre[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b], group[group == group[b]] = False, group[a]
        cost[b, :] = cost[:, b] = np.inf
        new = n[a] * n / (n[a] + n) * ((centre - centre[a]) ** 2).sum(axis=1)
        new[~alive] = np.inf
        new[a] = np.inf
        cost[a, :] = cost[:, a] = new
    _, numbers = np.unique(group, return_inverse=True)
    return numbers


def cluster_by_features(df: DataFrame, clusters: int = 7, entries: int = ENTRIES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``cluster``, from 0 in falling order of size; ``features`` is the vector to cluster by, and goes."""
    points = df.withColumn("x", vector_to_array("features"))
    held = gather(points, entries, threshold)
    if held is None:
        return df.drop("features").withColumn("cluster", F.lit(0))
    groups = joined(held, min(clusters, len(held.n)))
    order = np.argsort(-np.bincount(groups, held.n), kind="stable")
    numbers = np.argsort(order)[groups].astype(np.int32)
    centres = held.total / held.n[:, None]  # at most ``entries`` rows, so the function carries them

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        rows, out = np.array(x.tolist(), float).reshape(len(x), -1), np.zeros(len(x), np.int32)
        for at in range(0, len(rows), 1024):
            part = rows[at:at + 1024]
            out[at:at + 1024] = numbers[((part[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)] if len(part) else 0
        return pd.Series(out)

    return points.withColumn("cluster", nearest("x")).drop("x", "features")
