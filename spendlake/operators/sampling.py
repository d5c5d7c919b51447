"""Reproducible sampling, splitting and encoding.

Rows are ordered by an md5 of their id and a seed: the same rows are drawn whatever the
partitioning, unlike a sampler that depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import UNKNOWN
from ..session import scratch_path, settle
from .ranking import with_group_position


def draw(row_id: str, seed: int) -> Column:
    """Uniform 32-digit hex text."""
    return F.md5(F.concat_ws("|", F.col(row_id), F.lit(str(seed))))


def stratified_sample(df: DataFrame, stratum: str, row_id: str, size: int, seed: int = 42) -> DataFrame:
    """About ``size`` rows, from each known stratum its share rounded half to even.

    Rounding may add a row to some strata; the largest ones give theirs back, so the sample
    never exceeds ``size``.

    Two passes instead of one sort per stratum: rows fall into buckets by the first four
    hex digits, whole buckets below the cut are taken as they are, and only the bucket at
    the cut is numbered. A stratum with a third of all rows spreads over 65,536 buckets.
    """
    known = df.filter(F.col(stratum).isNotNull()).withColumn("_draw", draw(row_id, seed))
    known = known.withColumn("_bucket", F.substring("_draw", 1, 4))
    total = df.select(F.count("*")).scalar()
    counts = known.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    shares = counts.groupBy(stratum).agg(F.bround(
        F.least(F.lit(float(size)) / total, F.lit(1.0)) * F.sum("_n")).cast("long").alias("_need"))
    surplus = F.sum("_need").over(W.partitionBy()) - size  # one row per stratum from here
    largest = F.row_number().over(W.orderBy(F.desc("_need"), stratum))
    shares = shares.withColumns({"_surplus": surplus, "_rank": largest}).select(
        stratum, (F.col("_need") - (F.col("_rank") <= F.col("_surplus")).cast("int")).alias("_need"))
    upto = W.partitionBy(stratum).orderBy("_bucket")  # at most 65,536 rows per stratum
    plan = (counts.withColumn("_end", F.sum("_n").over(upto)).join(shares, stratum)
            .withColumn("_open", F.col("_need") - (F.col("_end") - F.col("_n")))
            .filter(F.col("_open") > 0).groupBy(stratum).agg(
                F.max("_bucket").alias("_last"), F.max_by("_n", "_bucket").alias("_n"),
                F.max_by("_open", "_bucket").alias("_open")))
    marked = known.join(settle(plan), [stratum]).filter(F.col("_bucket") <= F.col("_last"))
    at_cut = (F.col("_bucket") == F.col("_last")) & (F.col("_open") < F.col("_n"))
    whole = marked.filter(~at_cut)
    place = W.partitionBy(stratum, "_bucket").orderBy("_draw", row_id)
    cut = (marked.filter(at_cut)
           .withColumn("_place", F.row_number().over(place))
           .filter(F.col("_place") <= F.col("_open")).drop("_place"))
    chosen = whole.unionByName(cut)
    return chosen.drop("_draw", "_bucket", "_last", "_n", "_open")


def with_split(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """``split``: 80 % train, 20 % test; a fifth of train is validation."""
    outer = _tenth(draw(row_id, seed), 1) % 5
    inner = _tenth(draw(row_id, seed), 9) % 5
    label = (F.when(outer == 0, "test").when(inner == 0, "validation").otherwise("train"))
    return df.withColumn("split", label)


def with_fold(df: DataFrame, row_id: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0..folds-1, shuffled."""
    return df.withColumn("fold", (_tenth(draw(row_id, seed), 17) % folds).cast("int"))


def _tenth(hexed: Column, start: int) -> Column:
    return F.conv(F.substring(hexed, start, 8), 16, 10).cast("long")


def with_block_fold(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """Contiguous folds over the sorted keys, so a key's rows share a fold."""
    keys = df.select(key).distinct()
    n = keys.select(F.count("*")).scalar()
    placed = with_group_position(keys.withColumn("_g", F.lit(0)), ["_g"], [key], "_at").drop("_g")
    fold = F.floor((F.col("_at") - 1) * folds / n).cast("int")
    return df.join(placed.select(key, fold.alias("fold")), key)


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, code``: alphabetical codes from 0, null as a value of its own.

    One pass finds the distinct values of all columns.
    """
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in columns])
    pairs = text.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("p"))
    values = pairs.select("p.column", "p.value").distinct()
    placed = with_group_position(values, ["column"], ["value"], "_at")
    return placed.select("column", "value", (F.col("_at") - 1).cast("int").alias("code"))


def stored_codes(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """``value, code`` of each column, written as Parquet, so that Spark knows how large each is."""
    path = scratch_path(df.sparkSession, "codes")
    label_codes(df, columns).withColumn("part", F.col("column")).write.partitionBy("part").parquet(path)
    every = df.sparkSession.read.schema("column string, value string, code int, part string").parquet(path)
    there = {row["part"] for row in every.select("part").distinct().collect()}  # names of columns
    return {name: df.sparkSession.read.schema("value string, code int").parquet(f"{path}/part={name}") if name in there
            else every.filter("false").select("value", "code") for name in columns}


def encode_labels(df: DataFrame, columns: list[str], codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add ``<name>_enc`` for each column.

    Dictionaries are files of known size: Spark broadcasts the short ones, all in one pass over the
    rows, and merges with a long one by key.
    """
    codes = stored_codes(df, columns) if codes is None else codes
    for name in columns:
        mine = codes[name].select(F.col("value").alias(f"_v_{name}"), F.col("code").alias(f"{name}_enc"))
        filled = F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN))
        df = df.join(mine, filled == F.col(f"_v_{name}"), "left")
        df = df.drop(f"_v_{name}")
    return df
