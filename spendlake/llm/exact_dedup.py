"""Exact deduplication by distributed radix partitioning, most significant bytes first.

All texts start in one group. Each pass splits every open group by the next bytes of its
texts; a digit is ``FIRST`` letters wide in the first pass and ``GROW`` times wider in each
one after, so the number of passes grows with the logarithm of the longest text that still
has a partner. A group is closed when it has one member, or when its texts have ended.
Members of a closed group that ended are equal: they agreed on every digit. No digest takes
part in the decision.

A pass counts its groups with partial sums on the map side and joins the counts back; that
join has nothing above it, so adaptive execution can split a group that holds a third of all
rows. After the first pass only rows with a partner carry the rest of their text. Each pass
is written to the shared folder, so a lost executor costs no earlier pass.

Defined results: a null text counts as empty. Of equal texts the smallest id stays, null ids
last; of rows that tie in that too, exactly one, by a row number given after the first pass.
An empty table gives no rows. Columns are read by name, so further columns are ignored. Texts
of any length are compared whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .shared import written

FIRST, GROW = 64, 4
SPACES = r"[\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                first: int = FIRST, grow: int = GROW) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), normal(F.col(text_column)).alias("norm")).select(
        "doc_id", "norm", F.substring("norm", 1, first).alias("digit"))
    sizes = rows.groupBy("digit").agg(F.count("*").alias("size"))
    shared = sizes.where("size > 1").select(F.col("digit").alias("d"), F.lit(True).alias("open"))
    state = written(
        rows.join(shared, rows.digit == shared.d, "left").select(
            "doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"),
            # The first digit and what follows it; null closes a group of one.
            F.when(F.col("open"), F.col("digit")).alias("digit"),
            F.when(F.col("open"), F.substring("norm", first + 1, 1 << 30)).alias("rest"),
            F.monotonically_increasing_id().alias("row")),
        "radix")
    done = [state.where("digit IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")]
    state = state.where("digit IS NOT NULL").withColumn("group", F.lit(-1).cast("long"))
    width = first
    while True:
        level = written(split(state, width), "radix")
        closed = level.where("group_size = 1 OR ended")
        done.append(closed.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keeper")).alias("kept"),
                                  "text_sha256"))
        width *= grow
        state = level.where("group_size > 1 AND NOT ended").select(
            "doc_id", "text_sha256", F.substring("rest", 1, width).alias("digit"),
            F.expr(f"substring(rest, {width + 1})").alias("rest"), "row", F.col("subgroup").alias("group"))
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def split(state: DataFrame, width: int) -> DataFrame:
    """One pass: the groups made by the next digit, their size and the row that would stay."""
    groups = state.groupBy("group", "digit").agg(
        F.count("*").alias("group_size"), F.min("row").alias("subgroup"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(
        F.col("group").alias("g"), F.col("digit").alias("d"), "group_size", "subgroup",
        F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keeper"))
    return state.join(groups, (state.group == groups.g) & (state.digit == groups.d)).select(
        "doc_id", "text_sha256", "row", "group_size", "subgroup", "keep_id", "keeper",
        (F.length("digit") < width).alias("ended"),
        F.when((F.col("group_size") > 1) & (F.length("digit") >= width), F.col("rest")).alias("rest"))
