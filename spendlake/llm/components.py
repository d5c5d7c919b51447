"""Connected components of a graph given as pairs, by alternating large and small stars.

Each turn hangs every node on the smallest node around it: first the larger neighbours of a
node, then the smaller ones. Both steps are a grouping for the smallest neighbour, with
partial sums on the map side, and a join that adaptive execution can split, so a node with
very many neighbours is no hot task. The number of turns grows with the logarithm of the
longest path. Each turn is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Scratch


def stars(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, root`` for every node of ``pairs`` (``a, b``): the smallest node of its component.

    The root itself has a row too. Pairs may repeat and come in any direction.
    """
    scratch = scratch or Scratch(pairs, "stars")
    edges = scratch.write(_ordered(pairs.select("a", "b").where("a <> b")), "links")
    state = None
    while True:
        edges = _small(_large(edges))
        edges = scratch.write(edges, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with ``a < b``."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return _ordered(both.where("b > a").join(least, F.col("a") == F.col("u")).select(
        F.col("m").alias("a"), "b").where("a <> b"))


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
    met = edges.join(least, F.col("b") == F.col("u"))
    return _ordered(met.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b"))
