"""A Merkle manifest of a table: a digest for each row, a root for all, and a proof for each row.

A row's leaf is the SHA-256 of its fields. The leaves of a source, in order of their ids, are
the first nodes of its tree; while several nodes remain, every ``FAN`` consecutive ones become
the digest of their hex texts. The sources' roots, in order of source, are the nodes of one
more tree, whose root stands for the table.

1. Rows are numbered within their source by range partitions, so a source of any size is
   spread; a number's digits to base ``FAN`` are columns.
2. Nodes that differ in their last ``DIGITS`` digits only form a block, at most
   ``FAN ** DIGITS`` of them. One shuffle brings a block together; then its digit columns are
   grouped away one after the other, and each grouping nests the structs of its members into
   one more level. A block ends as one row that holds its part of the tree.
3. The blocks' tops are the nodes of the next turn, until every source has one; a turn has a
   ``FAN ** DIGITS``-th of the rows of the one before.
4. Back down, a block's row meets the path above it, once for each block; a nested transform
   then makes the path of every node in it, and an explode gives them out. No row is joined
   with its siblings.

A path is an array with, for each level from the leaf up, the digests to the left and to the
right of the node in its run. The proof's digest and the folded root follow from it alone.

Defined results: null fields count as ``-``, so a null text and an empty one have different
leaves. Null ids come first in their source; rows of equal ids go by leaf, and rows equal in
all fields take places next to each other, each with its own proof. A null source is a source of its
own and comes first. A source of one row has that row's leaf as its root; a table of one row has it as
its root too, and an empty proof. Null ids are never tampered with. An empty table gives no
rows. Fields are read by name, so further columns are ignored. Texts of any length are read
whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import Scratch

FAN, DIGITS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATH = "array<struct<left:string,right:string>>"


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row's fields, each with its length in bytes before it."""
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
             for f in (field.cast("string") for field in fields)]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, scratch: Scratch, *order: str) -> DataFrame:
    """Adds ``r``, the row's place from 0 in its ``tree`` by the ``order`` columns, and ``n``, the tree's rows."""
    ranged = scratch.write(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumns(
        {"slice": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "numbered")
    counts = ranged.groupBy("tree", "slice").agg(F.count("*").alias("c"), F.min("row").alias("zero"))
    earlier = W.partitionBy("tree").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # a row a slice
    starts = counts.select("tree", "slice", (F.col("zero") - F.coalesce(F.sum("c").over(earlier), F.lit(0))).alias("shift"),
                           F.sum("c").over(W.partitionBy("tree")).alias("n"))
    return ranged.join(starts, ["tree", "slice"]).withColumn("r", F.col("row") - F.col("shift")).drop(
        "slice", "row", "shift", *order)


def nest(nodes: DataFrame, digits: int = DIGITS, fan: int = FAN) -> DataFrame:
    """``tree, n, r, node, item`` to a row a block: ``tree, n, block, node, kids``, the digits nested in ``kids``.

    A level that a tree doesn't have, because one node was left before it, keeps that node.
    """
    over = lambda by: F.call_function("div", F.col("r"), F.lit(by))
    rows = nodes.select("tree", "n", over(fan ** digits).alias("block"), "node", F.col("item").alias("kids"), *[
        (over(fan ** level) % fan).cast("int").alias(f"d{level}") for level in range(digits)])
    rows = rows.repartition("tree", "n", "block")  # all groupings below stay where the rows are
    for level in range(digits):
        rest = ["tree", "n", "block", *[f"d{upper}" for upper in range(level + 1, digits)]]
        rows = rows.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(
            F.col(f"d{level}").alias("digit"), "node", "kids"))).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda kid: kid["node"]), "")
        rows = rows.withColumn("node", F.when(F.col("n") > fan ** level, F.sha2(joined, 256)).otherwise(
            F.col("kids")[0]["node"]))
    return rows


def climb(nodes: DataFrame, scratch: Scratch, digits: int = DIGITS) -> list[DataFrame]:
    """The blocks of each turn; a tree is in all turns up to the one that leaves it a single block."""
    size, turns = FAN ** digits, []
    while True:
        turns.append(scratch.write(nest(nodes, digits), "blocks"))
        left = turns[-1].where(F.col("n") > size)
        if left.isEmpty():
            return turns
        nodes = left.select("tree", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("r"), "node",
                            F.struct(F.col("block").alias("block")).alias("item"))


def tops(turns: list[DataFrame], digits: int = DIGITS) -> DataFrame:
    """A row for each tree: its root and the turn that made it."""
    return reduce(DataFrame.unionByName, [
        blocks.where(F.col("n") <= FAN ** digits).select("tree", F.lit(turn).alias("turn"), "node")
        for turn, blocks in enumerate(turns)])


def paths(kids: Column, above: Column, n: Column, level: int) -> Column:
    """The nodes below, as an array of their own digest, item and path to the root."""
    def beside(i: Column) -> Column:
        around = lambda start, length: F.array_join(F.transform(
            F.slice(kids, start, length), lambda kid: kid["node"]), "")
        here = F.array(F.struct(around(1, i).alias("left"), around(i + 2, F.lit(FAN)).alias("right")))
        return F.concat(F.when(n > FAN ** level, here).otherwise(F.array().cast(PATH)), above)

    if level == 0:
        return F.transform(kids, lambda kid, i: F.struct(kid["node"].alias("node"), kid["kids"].alias("item"),
                                                         beside(i).alias("path")))
    return F.flatten(F.transform(kids, lambda kid, i: paths(kid["kids"], beside(i), n, level - 1)))


def descend(turns: list[DataFrame], roots: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``node, item, path, roots`` of every node of the first turn.

    ``roots``: ``tree, turn, path, roots``, what lies above each tree's root, and what to hand down.
    """
    below = None
    for turn in reversed(range(len(turns))):
        above = roots.where(F.col("turn") == turn).select("tree", F.lit(0).cast("long").alias("block"), "path", "roots")
        if below is not None:
            above = above.unionByName(below.select("tree", F.col("item.block").alias("block"), "path", "roots"))
        met = turns[turn].join(above, ["tree", "block"])
        below = met.select("tree", "roots", F.inline(paths(F.col("kids"), F.col("path"), F.col("n"), digits - 1)))
    return below


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda acc, run: F.sha2(F.concat(run["left"], acc, run["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, path, folded_root, verified``.

    Where ``tampered`` holds, the row is checked as if ``A`` to ``Z`` in its text had been lower-cased.
    """
    scratch = Scratch(docs, "merkle")
    fields = [F.col(f"`{name}`") for name in FIELDS]
    changed = leaf_of([*fields[:-1], F.translate(fields[-1].cast("string"), UPPER, UPPER.lower())])
    leaf = leaf_of(fields)
    check = leaf if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), changed).otherwise(leaf)
    source = F.col("source").cast("string")
    leaves = scratch.write(docs.select(
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("s"), source)).alias("tree"), F.col("doc_id").cast("long").alias("id"),
        leaf.alias("node"), check.alias("check"), F.monotonically_increasing_id().alias("tie")), "leaves")
    nodes = leaves.select("tree", "node", "id", F.col("node").alias("by"), "tie", F.struct(
        F.col("id").alias("doc_id"), "check").alias("item"))
    sources = climb(numbered(nodes, scratch, "id", "by", "tie"), scratch, digits)
    subroots = tops(sources, digits).select(F.lit("").alias("tree"), "node", F.struct("tree", "turn").alias("item"),
                                            F.col("tree").alias("source"))
    table = climb(numbered(subroots, scratch, "source"), scratch, digits)
    root = tops(table, digits).select("tree", "turn", F.array().cast(PATH).alias("path"), F.struct(
        F.col("node").alias("root")).alias("roots"))
    above = descend(table, root, digits).select("item.tree", "item.turn", "path", F.struct(
        F.col("node").alias("subroot"), "roots.root").alias("roots"))
    rows = descend(sources, scratch.write(above, "above"), digits)
    return rows.select(F.col("item.doc_id").alias("doc_id"), F.col("node").alias("leaf"), "roots.subroot", "roots.root", "path",
                       folded(F.col("item.check"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def prove(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The manifest with every fifth row (by the checksum of its id) tampered with, and proofs as digests."""
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, tampered, digits).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
