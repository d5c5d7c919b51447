"""How filters that remove documents act on each other, for every order in which they can run.

1. Each document gets a bit for each filter it fails. Copies are found by a 256-bit digest of
   the text: of equal texts only those with the smallest id pass the copy filter, whatever the
   other filters do.
2. Documents with the same part, bits and labels become one cell with a count; there are at
   most 32 bit patterns and four label pairs in a part, so partial sums leave few rows.
3. The removal game of a part: the worth ``v(S)`` of a coalition of filters is the number of
   documents that any of them fails. It is summed for all 32 coalitions.
4. The Hart-Mas-Colell potential follows recursively from smaller coalitions to larger ones,
   ``P(S) = (v(S) + sum of P(S without i)) / |S|``. It is kept as ``|S|! P(S)``, a whole number. A
   filter's Shapley value is the potential of all filters minus that of all without it.
5. A step of an order is a difference of two coalitions: of the filters up to it, and before it.

Defined results: a null text counts as empty; the empty text fails ``A`` alone (and ``E`` if it
repeats). Rows equal in id and text don't fail ``E`` for each other; a row with a null id neither has a
smaller id nor is one. A null part is the empty string, together with a part of that name. A
document is good, or toxic, if any of its label rows says so; labels without a document and null
labels count for nothing, and a null id has no labels. Every part in the table has a row for
each order and step, with zeros where nothing falls to it; an empty table gives no rows. Columns
are read by name, so further columns are ignored. Whole texts of any length are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from .shared import Scratch

FILTERS = "ABCDE"
COPIES = "E"
WORD = r"[^\x20\x09-\x0D]+"
MADE = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def bits(failures: dict[str, Column]) -> Column:
    return reduce(add, [F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in failures.items()])


def failed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, part, mask``: the filters that each document fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.write(docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), bits(own_failures(text)).alias("mask")), "failed")
    copied = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1").select(
        F.col("digest").alias("same"), "least")
    # A join with nothing above it that needs a text's rows together, so a hot text is split.
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return rows.join(copied, F.col("digest") == F.col("same"), "left").select(
        "id", "part", (F.col("mask") + bits({COPIES: copy})).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, good and toxic ones that fail the same filters."""
    says = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("long")).alias(name)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        says("quality"), says("toxic"))
    return rows.join(known, F.col("id") == F.col("labelled"), "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def games(counted: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """Per part: the number of documents, and of each kind an array of the worth of every coalition."""
    every = (1 << filters) - 1
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    worth = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("coalition")).groupBy(
        "part", "coalition").agg(F.sum("n").alias("all"), *[
            F.sum(F.when(hit, F.col(kind)).otherwise(0)).alias(kind) for kind in ("n", "good", "toxic")])
    inner = F.sort_array(F.collect_list(F.struct("coalition", "n", "good", "toxic")))  # a row for each coalition
    return worth.groupBy("part").agg(F.first("all").alias("all"), inner.alias("game")).select(
        "part", "all", "game.n", "game.good", "game.toxic")


def at(values: Column, coalition: Column) -> Column:
    return F.get(values, coalition.cast("int"))


def potentials(worth: Column, filters: int = len(FILTERS)) -> Column:
    """Potential times the factorial of the coalition's size, for every coalition in turn."""
    factorials = F.array(*[F.lit(factorial(max(size - 1, 0))).cast("long") for size in range(filters + 1)])

    def grow(known: Column, coalition: Column) -> Column:
        smaller = reduce(add, [F.when(coalition.bitwiseAND(F.lit(1 << i)) != 0, at(known, coalition.bitwiseXOR(
            F.lit(1 << i)))).otherwise(F.lit(0)) for i in range(filters)])
        own = F.get(factorials, F.bit_count(coalition)) * at(worth, coalition)
        return F.concat(known, F.array((own + smaller).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), grow)


def steps(game: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order and step."""
    n = len(filters)
    every = (1 << n) - 1
    orders = F.array(*[F.lit("".join(order)) for order in permutations(filters)])
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(filters), letter) - 1)
    rows = game.withColumn("potential", potentials(F.col("n"), n)).select(
        "*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    earlier = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.when(
        k < F.col("step"), bit(F.substring(F.col("filter_order"), k, F.lit(1)))).otherwise(F.lit(0)))
    rows = rows.withColumns({"own": bit(letter), "before": F.aggregate(earlier, F.lit(0), lambda a, x: a + x)})
    upto, others = F.col("before") + F.col("own"), F.lit(every) - F.col("own")
    gained = lambda kind: at(F.col(kind), upto) - at(F.col(kind), F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("all") - at(F.col("n"), upto)).alias("kept"), gained("n").alias("removed"),
        (at(F.col("n"), F.col("own")) - gained("n")).alias("redundant"),
        (at(F.col("n"), F.lit(every)) - at(F.col("n"), others)).alias("unique_fails"),
        gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"),
        # n! times the Shapley value: the sum over all orders.
        (at(F.col("potential"), F.lit(every)) - n * at(F.col("potential"), others)).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (``lang``), order of the five filters and step: what is removed there, and the filter's Shapley value."""
    scratch = Scratch(docs, "audit")
    counted = scratch.write(cells(failed(docs, scratch), labels), "cells")
    return steps(games(counted))
