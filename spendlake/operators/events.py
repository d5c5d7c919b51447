"""Event calendar: scores, counts, alignment with spend, and the model feature frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import month_of, season_cos, season_sin
from ..schema import DEFAULT_REFERENCE
from ..session import settle
from .clean import known_keys

#: Halving weights carry 16 digits, so the weight of rank 56 and beyond is exactly 0.
LAST_WEIGHTED_RANK = 55


def event_scores(events: DataFrame) -> DataFrame:
    """Score per state and month: scores falling, each next one at half the weight.

    Only ranks with a non-zero weight are kept. The rank filter lets Spark cut every map
    task's rows to that many per cell before the shuffle, so a hot cell stays small.
    """
    cell = W.partitionBy("state", "year_month").orderBy(F.desc("score"), "name")
    ranked = (known_keys(events, ["state", "year_month"])
              .withColumn("rank", F.row_number().over(cell))
              .filter(F.col("rank") <= LAST_WEIGHTED_RANK))
    weight = F.pow(F.lit(0.5), F.col("rank") - 1).cast("decimal(20,16)")
    term = F.col("score").cast("decimal(10,2)") * weight
    return ranked.groupBy("state", "year_month").agg(
        F.round(F.sum(term), 4).cast("double").alias("event_score"))


def event_counts(events: DataFrame) -> DataFrame:
    """Number of events and highest score per state and month."""
    return known_keys(events, ["state", "year_month"]).groupBy("state", "year_month").agg(
        F.count("*").alias("event_count"), F.max("score").alias("max_event"))


def event_panel(events: DataFrame, uplift: DataFrame) -> DataFrame:
    """Score, count, highest score and uplift per state and month."""
    keys = ["state", "year_month"]
    return (event_scores(events).join(event_counts(events), keys)
            .join(uplift, keys, "full").fillna(0.0))


def state_month_spine(states: DataFrame, months: Column) -> DataFrame:
    """Every state with every month of an array."""
    return states.select("state").distinct().select("state", F.explode(months).alias("year_month"))


def score_grid(events: DataFrame, states: DataFrame, months: Column) -> DataFrame:
    """Scores on the full state-month grid, 0 where nothing happens."""
    spine = state_month_spine(states, months)
    return (spine.join(event_scores(events), ["state", "year_month"], "left")
            .fillna({"event_score": 0.0}))


def busiest_states(events: DataFrame, states: DataFrame, months: Column, n: int = 30) -> DataFrame:
    """States by the sum of their scores over the months."""
    grid = score_grid(events, states, months)
    total = F.round(F.sum("event_score"), 4).alias("total_score")
    return grid.groupBy("state").agg(total).orderBy(F.desc("total_score"), "state").limit(n)


def best_event(events: DataFrame, states: DataFrame, first: int, last: int,
               default: str = "—") -> DataFrame:
    """The highest-scoring event of each state in a period; ties go to the first name."""
    inside = events.filter(F.col("year_month").between(first, last))
    best = inside.groupBy("state").agg(
        F.min_by("name", F.struct(-F.col("score"), F.col("name"))).alias("top_event"),
        F.max("score").alias("top_score"))
    return (states.select("state").distinct().join(best, "state", "left")
            .fillna({"top_event": default, "top_score": 0.0}))


def severity(score: str = "event_score") -> Column:
    col = F.col(score)
    return F.when(col >= 60, "high").when(col >= 25, "medium").otherwise("low")


def event_detail(spine: DataFrame, events: DataFrame, uplift: DataFrame,
                 spend: DataFrame) -> DataFrame:
    """State-month detail, one row per event; a month without events keeps one row.

    The events stay rows instead of a list per cell: a cell's list has no size bound. They are
    the side of the join that adaptive execution can split when a cell is hot; the settled
    months have one row per cell.
    """
    keys = ["state", "year_month"]
    months = (spine.join(event_scores(events), keys, "left").join(uplift, keys, "left")
              .join(spend, keys, "left")
              .withColumn("_quiet", F.col("event_score").isNull())
              .fillna({"event_score": 0.0, "uplift_m": 0.0})
              .withColumn("spend", F.coalesce("spend", F.lit(0)))
              .withColumn("severity", severity()))
    months = settle(months)
    names = [*[c for c in months.columns if c != "_quiet"], "name", "score"]
    busy = events.select(*keys, "name", "score").join(months.filter(~F.col("_quiet")), keys)
    quiet = months.filter("_quiet").withColumns({
        name: F.lit(None).cast(events.schema[name].dataType) for name in ("name", "score")})
    return busy.select(names).unionByName(quiet.select(names))


def with_lags(panel: DataFrame, keys: list[str], value: str = "spend") -> DataFrame:
    """log1p of the three latest known months before each row, and their mean.

    A missing first lag is 0, a missing later one repeats the lag before it.
    """
    window = W.partitionBy(*keys).orderBy("year_month")
    logged = F.log1p(F.col(value).cast("double"))
    lag = lambda k: F.lag(logged, k).over(window)
    return (panel
            .withColumns({"_l1": lag(1), "_l2": lag(2), "_l3": lag(3)})
            .withColumn("lag1", F.coalesce("_l1", F.lit(0.0)))
            .withColumn("lag2", F.coalesce("_l2", "lag1"))
            .withColumn("lag3", F.coalesce("_l3", "lag2"))
            .withColumn("roll3", (F.col("lag1") + F.col("lag2") + F.col("lag3")) / 3)
            .drop("_l1", "_l2", "_l3"))


def prior_year(panel: DataFrame, keys: list[str], value: str = "spend") -> DataFrame:
    """Value of the same month one year before, by key: months in between may be missing."""
    before = panel.select(*keys, (F.col("year_month") + 100).alias("year_month"),
                          F.col(value).alias("prior_year"))
    return panel.join(before, [*keys, "year_month"], "left")


REFERENCE_FEATURES = ["log_population", "log_gdp", "log_tourism", "log_hotel_rooms"]
EVENT_FEATURES = ["event_score", "event_count", "max_event", "uplift_m"]
LAG_FEATURES = ["lag1", "lag2", "lag3", "roll3"]
FEATURES = [*REFERENCE_FEATURES, "month_sin", "month_cos", *EVENT_FEATURES, *LAG_FEATURES, "month"]


def with_reference(df: DataFrame, reference: DataFrame) -> DataFrame:
    """log1p of the state factors; an unknown state takes the default row."""
    known = df.join(reference.select("state", *DEFAULT_REFERENCE), "state", "left")
    known = known.fillna(DEFAULT_REFERENCE)
    sources = dict(zip(REFERENCE_FEATURES, DEFAULT_REFERENCE))
    return (known.withColumns({name: F.log1p(F.col(src)) for name, src in sources.items()})
            .drop(*DEFAULT_REFERENCE))


def with_season(df: DataFrame, month: Column | str = "year_month") -> DataFrame:
    return df.withColumns({"month_sin": season_sin(month), "month_cos": season_cos(month),
                           "month": month_of(month)})


def feature_frame(panel: DataFrame, reference: DataFrame, events: DataFrame,
                  uplift: DataFrame) -> DataFrame:
    """``state, year_month, spend`` plus the model features and the log1p target."""
    return feature_rows(panel, reference, event_panel(events, uplift))


def feature_rows(panel: DataFrame, reference: DataFrame, event_months: DataFrame) -> DataFrame:
    """The feature frame from an event panel that is there already."""
    lagged = with_lags(panel, ["state"])
    joined = lagged.join(event_months, ["state", "year_month"], "left").fillna(0.0, subset=EVENT_FEATURES)
    full = with_season(with_reference(joined, reference))
    return full.select("state", "year_month", "spend", *[F.col(c).cast("double") for c in FEATURES],
                       F.log1p(F.col("spend").cast("double")).alias("target"))
