"""Order-based operators over whole frames: positions, running sums, quantiles, top lists.

A window without a partition key sends every row to one task. Here the rows are range
partitioned, numbered inside each slice, and shifted by what lies before the slice. The
slices are settled on reliable storage first, because range bounds are sampled and must
be the same in both reads. Ties are split by the key in the sort order, so equal values
do not pile up in one slice.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ratio_or_zero
from ..session import settle, stored


def with_position(df: DataFrame, order: list[Column | str], position: str = "position",
                  running: dict[str, str] | None = None) -> DataFrame:
    """1-based position in a total order, and running sums ``{output: column}``.

    Runs one job: the range-partitioned and sorted rows are written to the checkpoint
    folder with their number in the slice. Positions then need no second shuffle; running
    sums take one, by slice. The number of slices is left to adaptive execution, which
    merges neighbouring small ones.
    """
    running = running or {}
    ranged = settle(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumns({"_slice": F.spark_partition_id(),
                                  "_row": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_slice").agg(
        F.count("*").alias("_rows"), F.min("_row").alias("_zero"),
        *[F.sum(column).alias(f"_sum_{out}") for out, column in running.items()])
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # one row per slice
    offsets = sizes.select(
        "_slice", "_zero", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}")
          for out in running])
    upto = (W.partitionBy("_slice").orderBy("_row")
            .rowsBetween(W.unboundedPreceding, W.currentRow))
    # At most one row per shuffle partition, so its size is known.
    return ranged.join(F.broadcast(offsets), "_slice").select(
        *df.columns,
        (F.col("_before") + F.col("_row") - F.col("_zero") + 1).alias(position),
        *[(F.col(f"_before_{out}") + F.sum(column).over(upto)).alias(out)
          for out, column in running.items()])


def with_group_position(df: DataFrame, groups: list[str], order: list[Column | str],
                        position: str = "position") -> DataFrame:
    """1-based position inside each group, also for a group too large for one task."""
    placed = with_position(df, [*groups, *order], "_global")
    starts = placed.groupBy(*groups).agg((F.min("_global") - 1).alias("_start"))
    return (placed.join(starts, groups)
            .withColumn(position, F.col("_global") - F.col("_start"))
            .drop("_global", "_start"))


def pareto(df: DataFrame, key: str, value: str = "total_spend") -> DataFrame:
    """Keys by falling value: rank, rank %, running sum, running %."""
    placed = with_position(df.select(key, value), [F.desc(value), key], "rank",
                           running={"cum_spend": value})
    total = df.select(F.sum(value)).scalar()
    n = df.select(F.count("*")).scalar()
    return placed.withColumns({
        "cum_pct": ratio_or_zero(F.col("cum_spend") * 100, total),
        "rank_pct": F.col("rank") / n * 100,
    })


def concentration(df: DataFrame, key: str, value: str = "total_spend",
                  shares: tuple[float, ...] = (0.01, 0.10, 0.20), compat: bool = False) -> DataFrame:
    """Percent of all spend held by the top share of keys.

    The top group is ``floor(n * share)`` keys, at least one. ``compat`` takes one more.
    """
    ranked = pareto(df, key, value)
    n = df.select(F.count("*")).scalar()
    extra = 1 if compat else 0
    held = []
    for share in shares:
        size = F.greatest(F.floor(n * F.lit(share)) + extra, F.lit(1))
        inside = F.when(F.col("rank") <= size, F.col("cum_pct"))
        held.append((f"top_{_pct(share)}pct", inside))
    marked = ranked.select(*[inside.alias(name) for name, inside in held])
    return marked.agg(*[F.max(name).alias(name) for name, _ in held])


def _pct(share: float) -> str:
    return f"{share * 100:g}".replace(".", "_")


def gini(df: DataFrame, key: str, value: str = "total_spend") -> DataFrame:
    """Gini coefficient ``2 sum(i v_i) / (n sum v) - (n + 1) / n``, values rising."""
    placed = with_position(df.select(key, value), [F.asc(value), key], "i")
    n, total = F.count("*"), F.sum(value).cast("double")
    weighted = F.sum(F.col("i") * F.col(value)).cast("double")
    return placed.agg(
        n.alias("n"),
        (F.try_divide(2 * weighted, n * total) - (n + 1) / n).alias("gini"))


def quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float],
              accuracy: int = 2000) -> DataFrame:
    """Exact, linearly interpolated quantiles per group; ``probs`` maps output to fraction.

    A sketch per group first brackets each wanted rank. Values inside a bracket are then
    counted one by one, all values between two brackets as one cell of known ends, so a
    few percent of the rows are sorted instead of all. A rank that the sketch failed to
    bracket is an error, never a wrong number. Runs two jobs.
    """
    grouped = groups or ["_all"]
    source = (df if groups else df.withColumn("_all", F.lit(0))).select(*grouped, value)
    source = source.filter(F.col(value).isNotNull())
    margin = 4.0 / accuracy
    ends = [e for p in sorted(set(probs.values()))
            for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    # A file of known size: few groups are broadcast, where a shuffle would send each group to one task.
    brackets = stored(source.groupBy(*grouped).agg(F.percentile_approx(
        value, F.array(*[F.lit(e) for e in ends]), accuracy).alias("_edge")), "brackets")
    # Without groups there is one row of brackets, which scalars bring in without a join.
    placed = source.join(brackets, grouped) if groups else source.withColumn(
        "_edge", brackets.select("_edge").scalar())
    inside = reduce(or_, [F.col(value).between(F.get("_edge", F.lit(i)), F.get("_edge", F.lit(i + 1)))
                          for i in range(0, len(ends), 2)])
    passed = reduce(add, [(F.col(value) > F.get("_edge", F.lit(i))).cast("int")
                          for i in range(len(ends))])
    cells = placed.groupBy(*grouped, passed.alias("_zone"),
                           F.when(inside, F.col(value)).alias("_exact")).agg(
        F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    ordered = with_position(cells, [*grouped, "_low"], "_cell", running={"_end": "_n"})
    bounds = ordered.groupBy(*grouped).agg(
        F.min(F.col("_end") - F.col("_n")).alias("_first"), F.sum("_n").alias("_size"))
    sized = ordered.join(bounds, grouped) if groups else ordered.withColumns(
        {name: bounds.select(name).scalar() for name in ("_first", "_size")})
    spots = sized.withColumns({
        "_from": F.col("_end") - F.col("_n") - F.col("_first"),
        "_to": F.col("_end") - F.col("_first") - 1})
    picks, shape = [], []
    for name, p in probs.items():
        exact = F.lit(float(p)) * (F.col("_size") - 1)
        picks += [F.max(_value_at(F.floor(exact))).alias(f"_b_{name}"),
                  F.max(_value_at(F.ceil(exact))).alias(f"_a_{name}")]
        below, above = F.col(f"_b_{name}"), F.col(f"_a_{name}")
        shape.append((below + (above - below) * (exact - F.floor(exact))).alias(name))
    return spots.groupBy(*grouped, "_size").agg(*picks).select(*groups, *shape)


def _value_at(rank: Column) -> Column:
    """The value at a rank if this cell holds it: a cell knows its first and last value."""
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    value = (F.when((F.col("_from") == rank) | (low == high), low).when(F.col("_to") == rank, high)
             .otherwise(F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")))
    return F.when((F.col("_from") <= rank) & (F.col("_to") >= rank), value)


def summary(df: DataFrame, groups: list[str], value: str = "spend") -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum."""
    grouped = groups or ["_all"]
    source = df if groups else df.withColumn("_all", F.lit(0))
    moments = source.groupBy(*grouped).agg(
        F.count(value).alias("n"), F.avg(value).cast("double").alias("mean"),
        F.stddev_samp(F.col(value).cast("double")).alias("std"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"))
    names = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    if groups:
        out = moments.join(quantiles(source, groups, value, names), groups, "left")
    else:
        quarters = settle(quantiles(df, [], value, names))  # one row
        out = moments.withColumns({name: quarters.select(name).scalar() for name in names})
    return out.select(*groups, "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def top_rows(df: DataFrame, n: int, by: str, key: str, descending: bool = True) -> DataFrame:
    """The n first rows by a column; the key breaks ties."""
    return df.orderBy(F.desc(by) if descending else F.asc(by), key).limit(n)


def top_with_other(df: DataFrame, n: int, key: str, value: str = "spend") -> DataFrame:
    """The n largest keys, all others in one row ``Other``."""
    leaders = top_rows(df.groupBy(key).agg(F.sum(value).alias(value)), n, value, key).select(
        F.col(key).alias("_leader"))
    named = df.join(F.broadcast(leaders), F.col(key) == F.col("_leader"), "left")  # n rows
    label = F.coalesce("_leader", F.lit("Other"))
    return named.groupBy(label.alias(key)).agg(F.sum(value).alias(value))


def top_and_bottom(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """The n first and the n last rows, each with its side and rank."""
    best = W.orderBy(F.desc(by), key)
    worst = W.orderBy(F.asc(by), F.desc(key))
    top = df.orderBy(F.desc(by), key).limit(n).withColumns(
        {"side": F.lit("top"), "rank": F.row_number().over(best)})
    low = df.orderBy(F.asc(by), F.desc(key)).limit(n).withColumns(
        {"side": F.lit("bottom"), "rank": F.row_number().over(worst)})
    return top.unionByName(low)


def mean_rank(df: DataFrame, key: str, methods: list[str]) -> DataFrame:
    """Mean over methods of the tie-averaged rank, highest value first; null is unranked.

    The rank of equal values is the mean of their positions, which come from range partitions, so
    no task sees all keys. ``key`` names each row once.
    """
    out = df.select("*", F.lit(0.0).alias("_sum"), F.lit(0).alias("_known"))
    for method in methods:
        placed = with_position(df.filter(F.col(method).isNotNull()).select(F.col(key).alias("_key"), F.col(method).alias("_value")),
                               [F.desc("_value"), "_key"], "_at")
        ranks = placed.groupBy("_value").agg(F.avg("_at").alias("_rank")).withColumnRenamed("_value", "_same")
        ranked = placed.join(ranks, F.col("_value") == F.col("_same")).select("_key", "_rank")
        out = out.join(ranked, F.col(key) == F.col("_key"), "left").withColumns({
            "_sum": F.col("_sum") + F.coalesce("_rank", F.lit(0.0)),
            "_known": F.col("_known") + F.col("_rank").isNotNull().cast("int")}).drop("_key", "_rank")
    return out.withColumn("avg_rank", F.try_divide(F.col("_sum"), F.col("_known").cast("double"))).drop("_sum", "_known")


def consensus_rank(long: DataFrame, key: str, method: str, value: str,
                   depth: int = 15, keep: int = 10) -> DataFrame:
    """Mean position over each method's first ``depth`` keys; an absent key counts as ``depth``."""
    place = W.partitionBy(method).orderBy(F.desc(value), key)
    placed = (long.withColumn("_place", F.row_number().over(place))
              .filter(F.col("_place") <= depth))
    methods = long.select(F.count_distinct(method)).scalar()
    scored = placed.groupBy(key).agg(F.sum("_place").alias("_sum"), F.count("*").alias("_seen"))
    mean = (F.col("_sum") + (methods - F.col("_seen")) * depth) / methods
    return scored.select(key, mean.alias("avg_rank")).orderBy("avg_rank", key).limit(keep)
