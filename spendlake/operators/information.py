"""Mutual information of features of few values with a number, by nearest neighbours.

For a row with feature value x and target y, let r be the distance to the k-th nearest target
among the rows of the same x (all others, if there are fewer), and m the number of rows of any x
whose target is nearer than r, itself included. The estimate, in nats, is
``psi(n) + mean(psi(k)) - mean(psi(n_x)) - mean(psi(m))``, and 0 where that is negative. A value of
only one row has no neighbour; such rows take no part in that feature.

Targets are taken on a grid of ``GRID``, so all distances are whole numbers and ties are exact: where
the k-th neighbour has the same target, m counts the rows of that target.

All rows are put in order of their target once, each with its values of all features, and cut into
slices of ``SLICE`` positions. Most rows have their neighbours, and all rows within their distance, inside
their slice and are settled there for all features. Only the others, near a slice's ends or of rare
values, leave it, with the ``k`` rows around them and the ``k`` outermost rows of each value of each slice: among
these their neighbours come from positions in the order of a value's targets, in windows that hold a slice and
``k`` rows of its neighbours at most, and the rows within their distance are a difference of two ranks, found in
the slices that hold the two ends. Of equal targets of one value a slice sends ``k + 1`` rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import digamma
from ..session import scratch_path, settle, stored
from .ranking import with_group_position, with_position

NEIGHBOURS, GRID = 5, 1e-9
SLICE = 200_000
FAR = 2 ** 62  # farther than any two targets that leave a slice unsettled


def nearest_distance(rows: DataFrame, k: int, slice_rows: int = SLICE) -> DataFrame:
    """Adds ``_r``, the distance to the k-th neighbour in ``_y`` within ``feature, _x``.

    ``_p`` is the position from 0 among the ``_n`` rows of the value, in order of ``_y``.
    """
    if slice_rows <= k:
        raise ValueError("a slice holds more rows than there are neighbours")
    own = F.call_function("div", F.col("_p"), F.lit(slice_rows))
    at = F.col("_p") % slice_rows
    before = F.when((at < k) & (own > 0), own - 1)
    after = F.when((at >= slice_rows - k) & (F.col("_n") > (own + 1) * slice_rows), own + 1)
    spread = rows.withColumn("_own", own).withColumn("_slice", F.explode(F.array_compact(F.array(own, before, after))))
    order = W.partitionBy("feature", "_x", "_slice").orderBy("_p")  # at most a slice and 2 k rows
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    y = F.col("_y")
    around = []
    for j in range(k + 1):
        low, high = y - F.lag("_y", j).over(order), F.lead("_y", k - j).over(order) - y
        around.append(F.when(low.isNotNull() & high.isNotNull(), F.greatest(low, high)))
    # A value of k rows or fewer lies in one slice.
    few = F.greatest(y - F.min("_y").over(whole), F.max("_y").over(whole) - y)
    found = spread.withColumn("_r", F.when(F.col("_n") > k, F.least(*around)).otherwise(few))
    return found.filter(F.col("_own") == F.col("_slice")).drop("_own", "_slice")


def _digammas(n: np.ndarray) -> np.ndarray:
    """``functions.digamma`` for the whole numbers of a slice."""
    far = n + 10.0
    square = 1 / (far * far)
    tail = square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return np.log(far) - 0.5 / far - tail - sum(1 / (n + float(i)) for i in range(10))


def _settled(y: np.ndarray, codes: np.ndarray, k: int, low: float, high: float) -> tuple[np.ndarray, ...]:
    """One feature in a slice: sum over settled rows, and value, target and weight of rows that leave.

    ``y`` rises; beyond ``low`` and ``high`` other slices may hold rows. The weight says how many unsettled
    rows a row stands for.
    """
    order = np.argsort(codes, kind="stable")
    x, v, size = codes[order], y[order], len(y)
    reach = np.full(size, FAR)
    back = lambda j: np.concatenate([np.full(min(j, size), False), x[j:] == x[:max(size - j, 0)]])
    lags = [back(j) for j in range(k + 1)]
    for j in range(k + 1):
        here = lags[j].copy()
        here[max(size - (k - j), 0):] = False
        here[:max(size - (k - j), 0)] &= lags[k - j][k - j:]
        at = np.flatnonzero(here)
        reach[at] = np.minimum(reach[at], np.maximum(v[at] - v[at - j], v[at + (k - j)] - v[at]))
    closed = (reach < FAR) & (v - reach > low) & (v + reach < high)
    target, span = v[closed], np.maximum(reach[closed], 1)
    nearer = np.searchsorted(y, target + span - 1, "right") - np.searchsorted(y, target - span + 1, "left")
    leaves = ~closed
    for j in range(1, min(k, size - 1) + 1):
        same = lags[j][j:]
        leaves[j:] |= ~closed[:-j] & same
        leaves[:-j] |= ~closed[j:] & same
    leaves |= ~lags[k]  # the first k rows of each value, and the last
    last = np.ones(size, dtype=bool)
    last[:max(size - k, 0)] = ~lags[k][k:]
    leaves |= last
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (v[1:] != v[:-1])])) if size else np.arange(0)
    runs = np.diff(np.append(first, size))
    chosen = np.logical_or.reduceat(leaves, first) if size else leaves
    first, runs = first[chosen], runs[chosen]
    copies = np.minimum(runs, k + 1)
    at = np.repeat(first, copies)
    weight = np.zeros(len(at), dtype=np.int64)
    weight[np.cumsum(copies) - copies] = np.where(closed[first], 0, runs)
    return _digammas(nearer).sum(), x[at], v[at], weight


def _codes(pdf: pd.DataFrame, layout: list[tuple[str, int, int]] | None) -> np.ndarray:
    """A column a feature: the arrays ``_c``, or the bits that ``layout`` names as column, first bit and mask."""
    if layout is None:
        return np.stack(pdf["_c"].to_numpy())
    return np.stack([pdf[column].to_numpy() >> first & mask for column, first, mask in layout], axis=1)


def _packed(layout: list[tuple[str, int, int]] | None) -> list[str]:
    return ["_c"] if layout is None else list(dict.fromkeys(column for column, _, _ in layout))


def _slices_settled(placed: DataFrame, features: int, k: int, last: int,
                    layout: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Per slice and feature a row with the settled sum, and the rows that leave with ``_x, _y, _w``."""
    names = ["feature", "_slice", "_x", "_y", "_w", "_near"]

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, number = pdf.sort_values("_y"), int(key[0])
        y, codes = pdf["_y"].to_numpy(), _codes(pdf, layout)
        low = y[0] if number else -np.inf
        high = y[-1] if number < last else np.inf
        parts = []
        for f in range(features):
            known = codes[:, f] > 0
            near, x, v, weight = _settled(y[known], codes[known, f], k, low, high)
            parts.append(pd.DataFrame({"feature": f, "_slice": number, "_x": [0, *x], "_y": [0, *v],
                                       "_w": [0, *weight], "_near": [near, *np.zeros(len(x))]}))
        return pd.concat(parts)[names]

    return placed.select("_slice", "_y", *_packed(layout)).groupBy("_slice").applyInPandas(
        work, "feature int, _slice long, _x long, _y long, _w long, _near double")


def _rows_upto(placed: DataFrame, ends: DataFrame, features: int, layout: list[tuple[str, int, int]]) -> DataFrame:
    """``feature, _end, _upto``: the feature's rows with a target up to each end.

    ``ends`` holds each pair of ``feature, _end`` once. An end meets only the slice that begins last before it;
    what lies before that slice comes from one row a slice.
    """
    counts = [F.count_if(F.shiftright(column, first).bitwiseAND(F.lit(mask)) > 0).alias(f"_{f}")
              for f, (column, first, mask) in enumerate(layout)]
    table = placed.groupBy("_slice").agg(F.min("_y").alias("_first"), *counts).toPandas().sort_values("_slice")
    starts = table["_first"].to_numpy()
    own = table[[f"_{f}" for f in range(features)]].to_numpy()
    shared = placed.sparkSession.sparkContext.broadcast((starts, np.cumsum(own, axis=0) - own))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.searchsorted(shared.value[0], pdf["_end"].to_numpy(), "right") - 1
            yield pdf.assign(_slice=np.maximum(at, 0).astype(np.int64))

    def count(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(wanted):
            number, rows = int(wanted["_slice"].iloc[0]), rows.sort_values("_y")
            y, codes = rows["_y"].to_numpy(), _codes(rows, layout)
            for f, part in wanted.groupby("feature"):
                inside = np.searchsorted(y[codes[:, f] > 0], part["_end"].to_numpy(), "right")
                parts.append(part[["feature", "_end"]].assign(_upto=inside + shared.value[1][number, f]))
        return pd.concat(parts) if parts else pd.DataFrame({"feature": [], "_end": [], "_upto": []})

    placed_ends = ends.mapInPandas(locate, "feature int, _end long, _slice long")
    return placed.select("_slice", "_y", *_packed(layout)).groupBy("_slice").cogroup(placed_ends.groupBy("_slice")).applyInPandas(
        count, "feature int, _end long, _upto long")


def _coded(known: DataFrame, sizes: DataFrame, features: list[str]) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """``_y`` and, packed into few whole numbers, a number above 0 for the value of each feature; 0 where only one row has it.

    The numbers are files of known size, so Spark broadcasts short lists and merges with long ones. The layout
    names for each feature the column, the first bit and the mask of its number.
    """
    spark = known.sparkSession
    path = scratch_path(spark, "values")
    repeated = sizes.filter(F.col("_n") > 1).select("feature", "_x")
    with_group_position(repeated, ["feature"], ["_x"], "_code").write.partitionBy("feature").parquet(path)
    stored_codes = spark.read.schema("_x string, _code long, feature int").parquet(path)
    most = {row["feature"]: row["_most"] for row in stored_codes.groupBy("feature").agg(F.max("_code").alias("_most")).collect()}
    layout, words = [], [0]
    for f, name in enumerate(features):
        codes = spark.read.schema("_x string, _code long").parquet(f"{path}/feature={f}") if f in most else stored_codes.filter("false")
        mine = codes.select(F.col("_x").alias(f"_x{f}"), F.col("_code").alias(f"_c{f}"))
        known = known.join(mine, F.col(name) == F.col(f"_x{f}"), "left").drop(name, f"_x{f}")
        bits = max(most.get(f, 0).bit_length(), 1)
        if words[-1] + bits > 62:
            words.append(0)
        layout.append((f"_p{len(words) - 1}", words[-1], (1 << bits) - 1))
        words[-1] += bits
    word = lambda column: reduce(add, [F.shiftleft(F.coalesce(f"_c{f}", F.lit(0)).cast("long"), first)
                                       for f, (mine, first, _) in enumerate(layout) if mine == column])
    return known.select("_y", *[word(column).alias(column) for column in _packed(layout)]), layout


def _sliced(coded: DataFrame, slice_rows: int) -> DataFrame:
    """Adds ``_slice``, which numbers slices of at most ``slice_rows`` rows in order of ``_y``.

    Rows are range partitioned, and cut inside each part, so only what a row is made of moves and is written.
    ``_tie`` splits equal rows over parts.
    """
    tied = coded.withColumn("_tie", F.monotonically_increasing_id() % 1021)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = stored(tied.repartitionByRange("_y", *coded.columns[1:], "_tie").sortWithinPartitions("_y").drop("_tie").withColumns({
        "_part": F.spark_partition_id(), "_own": F.call_function("div", place, F.lit(slice_rows))}), "slices")
    sizes = parts.groupBy("_part").agg((F.max("_own") + 1).alias("_slices"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    before = sizes.select("_part", F.coalesce(F.sum("_slices").over(earlier), F.lit(0)).alias("_before"))
    # At most one row per shuffle partition, so its size is known.
    return parts.join(F.broadcast(before), "_part").withColumn("_slice", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def knn_mutual_information(df: DataFrame, features: list[str], target: Column, k: int = NEIGHBOURS,
                           grid: float = GRID, slice_rows: int = SLICE) -> DataFrame:
    """``feature, mutual_information, estimator``. A null feature is a value; rows without a target are left out."""
    if slice_rows <= k:
        raise ValueError("a slice holds more rows than there are neighbours")
    shown = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_v{f}") for f, c in enumerate(features)]
    # Two passes read the rows, and the joins that made them are not repeated.
    known = stored(df.select(F.round(target.cast("double") / grid).cast("long").alias("_y"), *shown).filter(F.col("_y").isNotNull()), "known")
    names = [f"_v{f}" for f in range(len(features))]
    long = known.select(F.posexplode(F.array(*names)).alias("feature", "_x"))
    sizes = settle(long.groupBy("feature", "_x").agg(F.count("*").alias("_n")))
    coded, layout = _coded(known, sizes, names)
    placed = _sliced(coded, slice_rows)
    last = placed.agg(F.max("_slice")).first()[0] or 0
    found = stored(_slices_settled(placed, len(features), k, last, layout), "found")

    left = with_position(found.filter(F.col("_x") > 0), ["feature", "_x", "_y", "_slice", "_w"], "_g")
    parts = left.groupBy("feature", "_x").agg(F.min("_g").alias("_first"), F.count("*").alias("_n"))
    rows = left.join(parts, ["feature", "_x"]).withColumn("_p", F.col("_g") - F.col("_first"))
    distant = nearest_distance(rows.select("feature", "_x", "_y", "_w", "_n", "_p"), k, slice_rows)
    reach = F.greatest("_r", F.lit(1))
    cells = settle(distant.filter(F.col("_w") > 0).groupBy(
        "feature", (F.col("_y") - reach).alias("_below"), (F.col("_y") + reach - 1).alias("_upto")).agg(F.sum("_w").alias("_w")))
    ends = cells.select("feature", F.explode(F.array("_below", "_upto")).alias("_end")).distinct()
    upto = stored(_rows_upto(placed, ends, len(features), layout), "upto")
    at = lambda name: upto.select(F.col("feature"), F.col("_end").alias(name), F.col("_upto").alias(f"_n{name}"))
    ranked = cells.join(at("_below"), ["feature", "_below"]).join(at("_upto"), ["feature", "_upto"])
    far = ranked.select("feature", (F.col("_w") * digamma(F.col("_n_upto") - F.col("_n_below"))).alias("_near"))
    own = found.select("feature", "_near").unionByName(far).groupBy("feature").agg(F.sum("_near").alias("_near"))

    n, neighbours = F.col("_n"), F.least(F.col("_n") - 1, F.lit(k))
    values = sizes.filter(n > 1).groupBy("feature").agg(
        F.sum("_n").alias("_all"), (F.sum(n * (digamma(neighbours) - digamma(n))) / F.sum("_n")).alias("_values"))
    told = values.join(own, "feature").select(F.col("feature").alias("_f"), F.greatest(F.lit(0.0), reduce(add, [
        digamma(F.col("_all")), F.col("_values"), -F.col("_near") / F.col("_all")])).alias("_mi"))
    every = sizes.select("feature").distinct()  # a feature without any repeated value tells nothing
    name = F.get(F.array(*map(F.lit, features)), F.col("feature")).alias("feature")
    return every.join(told, F.col("feature") == F.col("_f"), "left").select(
        name, F.coalesce("_mi", F.lit(0.0)).alias("mutual_information"), F.lit(f"k-NN, k = {k}").alias("estimator"))
