"""Exact top-k search by aggregation without random access.

Vectors become integer components ``floor(scale * x)``; the score is the integer inner product.
Candidates fall into blocks of about ``BLOCK`` rows and queries into blocks of about
``QUERIES``; every query block meets every candidate block in a task of its own, of bounded
size. There, each component has a list of the block's candidates in order of that component.
Lists are read from their best end for each query (the largest values first where the query's
component is positive, the smallest where it is negative), in steps of equal depth. A
candidate's lower bound takes the worst value of each list it was not yet met in, its upper bound the last
value read there. Candidates whose upper bound is below the k-th best lower bound are out;
reading stops once no query of a batch has more than ``OPEN`` candidates left, and the scores
of these are resolved from their components. Reading to the end gives the scores themselves.
The best k of each block then meet per query, pre-limited before the shuffle.

A step is written with matrices: its part of a list is the matrix of the values whose rank
falls in the step, so partial sums and bounds of a batch of queries are products. All numbers
are integers below 2**53 and exact; where they could be larger, scores are computed with
integers of any size instead and cut to 64 bits.

Defined results: vectors that are null, or hold a null or a number that is not finite, take no
part, nor do rows with a null id. Shorter vectors count as filled with zeros. A query's own
rows are those with its id, and they are never its results; if an id repeats, each of its
different vectors counts for results, and one of its vectors, the smallest, is the query.
Ties go to the smaller id. With fewer candidates than k all are returned. Empty tables give no
rows. Columns are read by name, so further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

K, SCALE = 5, 256
BLOCK, QUERIES = 8192, 1024
#: Depths, as shares of a list, after which bounds are compared; candidates that may stay open.
DEPTHS = (0.5, 0.75, 0.9, 1.0)
OPEN = 64


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def as_lists(column: pa.ChunkedArray) -> pa.ListArray:
    rows = column.combine_chunks()
    return pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows


def matrix(rows: pa.ListArray, width: int, scale: int = SCALE) -> np.ndarray:
    """Integer components of lists, filled with zeros to a width."""
    sizes = np.diff(rows.offsets.to_numpy())
    flat = np.floor(scale * rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(rows), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Lists:
    """The sorted lists of a block of candidates, cut at the depths."""

    def __init__(self, values: np.ndarray, depths=DEPTHS):
        n = len(values)
        self.values, self.ends = values, [max(1, round(n * d)) for d in depths]
        rank = values.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable")
        ordered = np.sort(values, axis=0)
        self.top, self.bottom = ordered[-1], ordered[0]
        self.steps, before = [], 0
        for end in self.ends:
            # From the best end down to ``end``: read in this step, not read yet, the last value read.
            high, low = n - 1 - rank, rank
            self.steps.append(tuple((
                np.where((r >= before) & (r < end), values, 0).T, (r >= end).T.astype(np.float64), last)
                for r, last in ((high, ordered[n - end]), (low, ordered[end - 1]))))
            before = end

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, most: int = OPEN) -> tuple[np.ndarray, np.ndarray]:
        """Row of the query, and candidate, of all that can be among the best k (ties included)."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        known = np.zeros((len(queries), len(self.values)))
        k = min(k, len(self.values))
        for (high, high_open, high_last), (low, low_open, low_last) in self.steps:
            known += plus @ high + minus @ low
            upper = known + (plus * high_last) @ high_open + (minus * low_last) @ low_open
            lower = known + (plus * self.bottom) @ high_open + (minus * self.top) @ low_open
            lower[own] = -np.inf
            upper[own] = -np.inf
            bar = np.partition(lower, len(self.values) - k, axis=1)[:, len(self.values) - k]
            left = (upper >= bar[:, None]) & ~own
            if left.sum(axis=1).max(initial=0) <= most:
                break
        return np.nonzero(left)


def search_block(candidates: pa.Table, queries: pa.Table, k: int, batch: int = 128) -> pa.Table:
    """The best k of a block for each query of a block."""
    ids, asked = candidates["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    found = {"query_id": [], "vec_id": [], "score": []}
    if len(ids) and len(asked):
        sides = [as_lists(t["vector"]) for t in (candidates, queries)]
        width = max(int(np.diff(s.offsets.to_numpy()).max()) for s in sides)
        x, q = (matrix(s, width) for s in sides)
        small = width * max(1, np.abs(x).max(initial=0)) * max(1, np.abs(q).max(initial=0)) < 2 ** 52
        lists = Lists(x) if small else None
        for at in range(0, len(asked), batch):
            part, names = q[at:at + batch], asked[at:at + batch]
            own = names[:, None] == ids[None, :]
            if small:
                row, col = lists.best(part, own, k)
                score = np.einsum("ij,ij->i", part[row], x[col]).astype(np.int64)
            else:
                row, col = np.nonzero(~own)
                whole = [[int(v) for v in line] for line in x]
                score = np.array([max(-2 ** 63, min(2 ** 63 - 1, sum(int(a) * b for a, b in zip(part[r], whole[c]))))
                                  for r, c in zip(row, col)], np.int64)
            order = np.lexsort((ids[col], -score.astype(object) if not small else -score, row))
            row, col, score = row[order], col[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            keep = nth < k
            found["query_id"].append(names[row[keep]])
            found["vec_id"].append(ids[col[keep]])
            found["score"].append(score[keep])
    return pa.table({name: pa.array(np.concatenate(parts) if parts else [], pa.int64()) for name, parts in found.items()})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for tables of ``vec_id, vector``."""
    good = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).groupBy(
        F.col("vec_id").cast("long").alias("query_id")).agg(F.min(F.col("vector").cast("array<double>")).alias("vector"))
    blocks = max(1, -(-good.count() // block))
    query_blocks = max(1, -(-queries.count() // query_block))
    # Each candidate meets each block of queries, and each query each block of candidates.
    left = good.withColumn("cb", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")).select(
        "vec_id", "vector", "cb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).select(
        "query_id", "vector", "qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    best = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(
        lambda x, y: search_block(x, y, k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
