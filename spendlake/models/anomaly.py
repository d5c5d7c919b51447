"""Isolation forest: trees from small samples, scoring spread over the executors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.ranking import quantiles
from ..operators.sampling import draw
from ..session import settle, stored

TREE_ROWS = 256  # fixed value: rows per tree


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int, float, int, float]]:
    """Nodes ``(node, feature, cut, left, depth)`` of one tree; feature -1 marks a leaf.

    The right child follows the left one. A leaf's depth counts the rows still in it.
    """
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple[int, int, float, int, float]] = []
    todo, next_id = [(0, x, 0)], 1
    while todo:
        node, rows, depth = todo.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append((node, -1, 0.0, -1, depth + _average_path(len(rows))))
            continue
        feature = int(rng.choice(spread))
        column = rows[:, feature]
        cut = float(rng.uniform(column.min(), column.max()))
        left = column <= cut
        nodes.append((node, feature, cut, next_id, float(depth)))
        todo += [(next_id, rows[left], depth + 1), (next_id + 1, rows[~left], depth + 1)]
        next_id += 2
    return nodes


def fit_trees(df: DataFrame, features: list[str], trees: int = 100, seed: int = 42) -> DataFrame:
    """Tree nodes from disjoint samples of 256 rows each, drawn by hashed order.

    The draw is a sampling operator: at most ``trees * 256`` rows leave the scan.
    """
    drawn = (df.select("row_id", *features).withColumn("_draw", draw("row_id", seed))
             .orderBy("_draw", "row_id").limit(trees * TREE_ROWS))
    numbered = drawn.withColumn("tree", F.pmod(
        F.row_number().over(W.orderBy("_draw", "row_id")) - 1, F.lit(trees)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values("_draw")[features].to_numpy(float)
        nodes = _grow(ordered, np.random.default_rng((seed, tree)))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "depth"])
        return out.assign(tree=tree, rows=len(ordered))

    return numbered.groupBy("tree").applyInPandas(
        grow, "node int, feature int, cut double, left int, depth double, tree int, rows int")


def _pack(tree: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Levels, and per node feature, cut, left child and depth. No value is above a leaf's cut, and its left child is itself."""
    feature, left, node = tree["feature"].to_numpy(), tree["left"].to_numpy(), np.arange(len(tree))
    inner = feature >= 0
    levels, level = 0, np.zeros(1, dtype=np.int64)
    while len(level := level[inner[level]]):
        levels, level = levels + 1, np.concatenate([left[level], left[level] + 1])
    # Depth as a share of the mean depth of a tree grown on as many rows.
    share = tree["depth"].to_numpy() / _average_path(max(2, int(tree["rows"].iloc[0])))
    return (levels, np.where(inner, feature, 0), np.where(inner, tree["cut"].to_numpy(), np.inf),
            np.where(inner, left, node), share)


def _depths(x: np.ndarray, forest: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the depths that each row reaches. All rows take as many steps as a tree has levels; at a leaf they stay."""
    flat, size = np.ascontiguousarray(x.T).ravel(), len(x)
    every, depth = np.arange(size), np.zeros(size)
    for levels, feature, cut, left, reached in forest:
        start, at = feature * size, np.zeros(size, dtype=np.int64)
        for _ in range(levels):
            spot = start.take(at, mode="clip") + every
            at = left.take(at, mode="clip") + (flat.take(spot, mode="clip") > cut.take(at, mode="clip"))
        depth += reached.take(at, mode="clip")
    return depth


def score(df: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Add ``anomaly_score`` in 0..1, higher is stranger.

    The node table is at most ``trees * 511`` rows whatever the data, so it is sent to the
    tasks; rows are scored where they lie, without a shuffle.
    """
    table = nodes.toPandas().sort_values(["tree", "node"])
    forest = [part.sort_values("node") for _, part in table.groupby("tree")]
    packed = [_pack(t) for t in forest]
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def rate(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(np.exp2(-_depths(rows.to_numpy(float), shared.value) / len(shared.value)))

    return df.withColumn("anomaly_score", rate(F.struct(*features)))  # only features go to Python, and a number back


def flag(scored: DataFrame, contamination: float = 0.02) -> DataFrame:
    """``is_anomaly`` for scores above the exact quantile that leaves the contamination share."""
    cut = quantiles(scored, [], "anomaly_score", {"cut": 1.0 - contamination}).select("cut").scalar()
    return scored.withColumn("is_anomaly", (F.col("anomaly_score") > cut).cast("int"))


def flagged(df: DataFrame, features: list[str], trees: int = 100) -> DataFrame:
    """Fits, scores and flags the rows of one frame."""
    nodes = settle(fit_trees(df, features, trees))
    return flag(stored(score(df, nodes, features), "scored"))
