"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Documents of a source fall into ``blocks`` blocks by a keyed function of their id, so no
   order over a source is needed, whatever its size; a block is about a thousandth of a source.
2. A source's target follows from its weight; what exceeds ``most`` times its size goes to
   the others by weight, until no target does.
3. Its quota in blocks: whole passes over all of its blocks, and one more pass over some of them.
   That pass walks the blocks in a permuted order and takes each that still fits into the rest of the
   target; then the smallest one left, if that comes nearer. ``TRIES`` orders are walked and the one that ends
   nearest is kept. No source misses its target by more than half its smallest block that was left.
4. The quotas are split among the output shards by a binary tree. At each node the left half
   gets its share of the node's blocks, drawn without replacement: the number from each source
   is hypergeometric given what the sources before it took. Quotas stay exact at every node.
5. A source's draws in permuted order are dealt to the shards in turn, so the shards' blocks
   are disjoint; within a shard rows are put in order by ``order_key``, a keyed function of
   the document and the copy.

The tables of steps 2 to 4 have a row for each source, block, or source and shard, never one
for each document. Sources are ranked in order of code points, null last.

Defined results: a null or empty text has size 0 and adds no words, whatever its block does.
Documents with equal ids share a block; null ids use the size in its place. Equal rows are
mixed one by one. A source without words has target 0. An empty table gives no rows. The id,
text and source columns are read by name; further columns are kept, and replaced if they have
the name of a column made here. Texts of any length count with all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ranking import with_position
from .permute import P, Q, inline, keys, mixed
from .shared import free, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCKS, SHARDS = 1024, 16
TRIES = 16
SEED = 31_337
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def block_of(doc_id: Column, size: Column, blocks: int, seed: int) -> Column:
    return (mixed(F.pmod(F.coalesce(doc_id.cast("long"), size), F.lit(P)), keys(seed, 1)[0]) % blocks).cast("int")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``weight`` and ``target`` to a table with a row for each source and its ``source_size``.

    In order of the rate at which a source would reach its cap, one is capped exactly if the rate of
    what the earlier ones leave exceeds its own; so running sums say all, however many sources there are.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = with_position(sources, [F.asc_nulls_last("source")], "source_rank").withColumns({
        "weight": weight.cast("long"), "cap": (most * F.col("source_size")).cast("long")}).withColumn(
        "full_at", F.col("cap") / F.col("weight").cast("double"))
    placed = written(with_position(ranked, ["full_at", "source_rank"], "_at", running={"caps": "cap", "weights": "weight"}), "caps")
    sums = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"))
    total, whole = sums.select(F.coalesce("size", F.lit(0)) * F.lit(float(share))).scalar(), sums.select("weight").scalar()
    rate_here = (total - (F.col("caps") - F.col("cap"))) / (whole - (F.col("weights") - F.col("weight")))
    known = written(placed.withColumn("capped", rate_here * F.col("weight") > F.col("cap")), "targets")
    left = known.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)).alias("caps"),
                     F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))), F.lit(0)).alias("weights"))
    rate = F.coalesce(F.try_divide(total - left.select("caps").scalar(), F.nullif(whole - left.select("weights").scalar(), F.lit(0))),
                      F.lit(0.0))
    return written(known.select("source", "source_rank", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        rate * F.col("weight")).alias("target")), "targets")


def quotas(sizes: DataFrame, wanted: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Per block with words: its place among the source's blocks and how often it is drawn."""
    in_source = W.partitionBy("source_rank").orderBy("place")  # at most ``blocks`` rows
    placed = sizes.where("block_size > 0").join(
        wanted.select(F.col("source").alias("s"), "source_rank", "source_size", "target"),
        F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("place", _order(F.col("block"), blocks, seed))
    passes = F.floor(F.col("target") / F.col("source_size"))
    placed = written(placed.withColumns({
        "passes": passes, "rest": F.col("target") - passes * F.col("source_size"),
        "nth": F.row_number().over(in_source) - 1}), "placed")
    more = best_pass(placed, seed).withColumnsRenamed({"source_rank": "_source", "block": "_block"})
    return placed.join(more, (F.col("source_rank") == F.col("_source")) & (F.col("block") == F.col("_block")), "left").withColumn(
        "copies", (F.col("passes") + F.col("_block").isNotNull().cast("int")).cast("int")).drop("_source", "_block")


def best_pass(placed: DataFrame, seed: int, tries: int = TRIES) -> DataFrame:
    """``source_rank, block`` of the blocks that the last pass takes."""
    # A keyed function of the block; one short expression for each order keeps the plan small.
    turn = lambda t: mixed(F.col("block").cast("long"), keys(seed + 1 + t, 1)[0])
    orders = F.array(*[F.struct(F.lit(t).alias("try"), turn(t).alias("turn")) for t in range(tries)])
    walks = placed.select("source_rank", "rest", "block", "block_size", F.inline(orders)).groupBy("source_rank", "try").agg(
        F.first("rest").alias("rest"), F.sort_array(F.collect_list(F.struct(
            "turn", "block", F.col("block_size").alias("words")))).alias("walk"))  # at most ``blocks`` entries
    start = F.struct(F.col("rest").alias("rest"), F.array().cast("array<int>").alias("taken"))
    ended = F.aggregate("walk", start, lambda at, b: F.when(b["words"] <= at["rest"], F.struct(
        (at["rest"] - b["words"]).alias("rest"), F.concat(at["taken"], F.array(b["block"])).alias("taken"))).otherwise(at))
    walks = walks.withColumn("end", ended)
    left = F.filter("walk", lambda b: ~F.array_contains(F.col("end.taken"), b["block"]))
    least = F.array_min(F.transform(left, lambda b: F.struct(b["words"].alias("words"), b["turn"].alias("turn"), b["block"].alias("block"))))
    walks = walks.withColumn("least", least)
    nearer = F.coalesce(F.col("least.words") < 2 * F.col("end.rest"), F.lit(False))
    miss = F.when(nearer, F.col("least.words") - F.col("end.rest")).otherwise(F.col("end.rest"))
    taken = F.when(nearer, F.concat(F.col("end.taken"), F.array("least.block"))).otherwise(F.col("end.taken"))
    best = walks.select("source_rank", F.struct(miss.alias("miss"), F.col("try"), taken.alias("taken")).alias("walk")).groupBy(
        "source_rank").agg(F.min("walk").alias("walk"))
    return best.select("source_rank", F.explode("walk.taken").alias("block"))


def _order(block: Column, blocks: int, seed: int) -> Column:
    """A permuted order of blocks; the network's values above ``blocks`` only leave gaps."""
    return inline(block.cast("long"), blocks, seed + 1, 3)


# The splitting tree ------------------------------------------------------------------


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``good + bad`` are good, by inversion from the mode outwards.

    Probabilities are taken relative to that of the mode, so nothing underflows that matters.
    """
    low, high = F.greatest(F.lit(0), draws - bad), F.least(good, draws)
    mode = F.least(F.greatest(F.floor((draws + 1) * (good + 1) / (good + bad + 2)), low), high)
    up = lambda x: (good - x) * (draws - x) / ((x + 1) * (bad - draws + x + 1))
    down = lambda x: x * (bad - draws + x) / ((good - x + 1) * (draws - x + 1))
    rising = F.when(high > mode, F.sequence(mode, high - 1)).otherwise(F.array().cast("array<bigint>"))
    falling = F.when(low < mode, F.sequence(mode, low + 1)).otherwise(F.array().cast("array<bigint>"))

    def walk(over: Column, ratio, step: int, wanted: Column) -> Column:
        """Adds up weights beyond the mode's until they pass ``wanted``; the value reached, and the sum."""
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), mode.cast("bigint").alias("x"),
                        F.lit(False).alias("found"))

        def add(acc: Column, x: Column) -> Column:
            w = acc["w"] * ratio(x)
            return F.when(acc["found"], acc).otherwise(F.struct(
                w.alias("w"), (acc["sum"] + w).alias("sum"), (x + step).cast("bigint").alias("x"),
                (acc["sum"] + w >= wanted).alias("found")))

        return F.aggregate(over, zero, add)

    never = F.lit(float("inf"))
    above, below = walk(rising, up, 1, never)["sum"], walk(falling, down, -1, never)["sum"]
    at = u * (1 + above + below)
    return F.when(at <= 1, mode.cast("bigint")).when(at <= 1 + above, walk(rising, up, 1, at - 1)["x"]).otherwise(
        walk(falling, down, -1, at - 1 - above)["x"])


def split_tree(quota: DataFrame, shards: int, seed: int) -> DataFrame:
    """Splits blocks per source (``source_rank, quota``) among shards: ``source_rank, shard, quota``.

    One level of the tree at a time. A node is a row with the quotas of all sources in order,
    so its width is the number of sources.
    """
    key = keys(seed + 2, 1)[0]
    nodes = quota.agg(F.sort_array(F.collect_list(F.struct("source_rank", "quota"))).alias("sources")).select(
        F.lit(0).alias("first"), F.lit(shards).alias("n"), "sources")
    while True:
        if nodes.where("n > 1").isEmpty():
            break
        left_n = F.floor(F.col("n") / 2)
        total = F.aggregate("sources", F.lit(0).cast("bigint"), lambda acc, s: acc + s["quota"])
        share = F.floor(total * left_n / F.col("n")).cast("bigint")
        start = F.struct(F.array().cast("array<bigint>").alias("left"), total.alias("rest"), share.alias("draws"))

        def draw(acc: Column, source: Column) -> Column:
            rest = acc["rest"] - source["quota"]
            u = (mixed(F.pmod(source["source_rank"] * 65_599 + F.col("first") * 4_099 + F.col("n"), F.lit(P)), key) + 0.5) / Q
            x = hypergeometric(source["quota"], rest, acc["draws"], u)
            return F.struct(F.concat(acc["left"], F.array(x)).alias("left"), rest.alias("rest"),
                            (acc["draws"] - x).alias("draws"))

        halved = nodes.withColumn("left", F.when(F.col("n") > 1, F.aggregate("sources", start, draw)["left"]))
        half = lambda pick: F.zip_with("sources", "left", lambda s, x: F.struct(
            s["source_rank"].alias("source_rank"), pick(s["quota"], x).alias("quota")))
        children = F.when(F.col("n") == 1, F.array(F.struct("first", "n", "sources"))).otherwise(F.array(
            F.struct(F.col("first"), left_n.cast("int").alias("n"), half(lambda q, x: x).alias("sources")),
            F.struct((F.col("first") + left_n).cast("int").alias("first"), (F.col("n") - left_n).cast("int").alias("n"),
                     half(lambda q, x: q - x).alias("sources"))))
        nodes = written(halved.select(F.inline(children)), "tree")
    return nodes.select(F.col("first").alias("shard"), F.inline("sources")).select("source_rank", "shard", "quota")


# On tables ---------------------------------------------------------------------------

MADE = ("size", "source_size", "target", "draws")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, shards: int = SHARDS,
         blocks: int = BLOCKS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text",
         source_column: str = "source") -> DataFrame:
    """Per document: ``size, source_size, target`` and ``draws``, an array of (copy, shard).

    The mix holds the document once for each draw.
    """
    size = words(F.col(text_column))
    sizes = written(docs.select(F.col(source_column).alias("source"), F.col(id_column).alias("id"), size.alias("size"))
                    .withColumn("block", block_of(F.col("id"), F.col("size"), blocks, seed))
                    .groupBy("source", "block").agg(F.sum("size").alias("block_size")), "blocks")
    wanted = targets(sizes.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, share, most)
    drawn = written(quotas(sizes, wanted, blocks, seed), "quotas")
    tree = split_tree(drawn.groupBy("source_rank").agg(F.sum("copies").cast("bigint").alias("quota")), shards, seed)
    upto = W.partitionBy("source_rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row a shard
    ranges = tree.withColumn("from", F.coalesce(F.sum("quota").over(upto), F.lit(0))).withColumn(
        "to", F.col("from") + F.col("quota")).groupBy("source_rank").agg(
        F.sort_array(F.collect_list(F.struct("to", "shard"))).alias("ranges"))
    # The draw number of a copy; a block's copies are drawn in passes over all blocks.
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    number = F.row_number().over(W.partitionBy("source_rank").orderBy("copy", "nth")) - 1  # at most ``most`` a block
    dealt = drawn.where("copies > 0").select("source_rank", "source", "block", "nth", copy).withColumn(
        "number", number).join(ranges, "source_rank").withColumn(
        "shard", F.filter("ranges", lambda r: F.col("number") < r["to"])[0]["shard"])
    of_block = dealt.groupBy("source_rank", "block").agg(
        F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("draws"))  # at most ``most`` copies
    mine, own_block, of_source = free(docs, "_b", "_block", "_source")
    by_block = wanted.select("source_rank", "source", "source_size", "target").join(
        sizes.select(F.col("source").alias("s"), "block"), F.col("source").eqNullSafe(F.col("s"))).join(
        of_block, ["source_rank", "block"], "left").select(
        F.col("source").alias(of_source), F.col("block").alias(own_block), "source_size", "target",
        F.coalesce("draws", F.array().cast("array<struct<copy:int,shard:int>>")).alias("draws"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MADE]
    return docs.select(*kept, size.alias("size")).withColumn(
        mine, block_of(F.col(id_column), F.col("size"), blocks, seed)).join(
        by_block, (F.col(mine) == F.col(own_block)) & F.col(source_column).eqNullSafe(F.col(of_source))).drop(
        mine, own_block, of_source)


def mix(docs: DataFrame, seed: int = SEED, id_column: str = "doc_id", **options) -> DataFrame:
    """The mix itself: a row for each draw, with ``copy``, ``shard`` and ``order_key``."""
    planned = plan(docs, seed=seed, id_column=id_column, **options)
    rows = planned.select(*[F.col(f"`{c}`") for c in planned.columns if c not in ("draws", "copy", "shard", "order_key")],
                          F.inline("draws"))
    return rows.withColumn("order_key", F.xxhash64(F.lit(seed), F.col(id_column), F.col("copy")))


def write_mix(mixed_rows: DataFrame, path: str) -> None:
    """One folder a shard, its rows in their shuffled order."""
    mixed_rows.repartition("shard").sortWithinPartitions("shard", "order_key").write.partitionBy("shard").parquet(path)
