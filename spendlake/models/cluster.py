"""Customer clusters on scaled log features."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.ml.clustering import BisectingKMeans, KMeans, KMeansModel
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .pool import together
from .regress import Scaler, assemble

CLUSTER_FEATURES = ["log_total_spend", "log_avg_spend", "transactions", "unique_categories",
                    "unique_distributors"]

#: Customers that one task of a fit holds.
TASK_ROWS = 50_000


def cluster_frame(profile: DataFrame) -> DataFrame:
    """Customer profile -> key, plain profile columns and scaled ``features``.

    The features are centred at 1. Distances are the same as around 0, but bisecting needs
    a first centre away from the origin: it splits by a shift relative to the centre.

    The profile is made once, for the scaling and for the features. A frame too large for one task is then
    dealt over as many as its rows ask for, so that the many passes of a fit use all cores.
    """
    logged = settle(profile.withColumns({
        "log_total_spend": F.log1p(F.col("total_spend").cast("double")),
        "log_avg_spend": F.log1p(F.col("avg_spend").cast("double"))}).fillna(0))
    scaler = Scaler.fit(logged, CLUSTER_FEATURES)
    tasks = math.ceil(logged.count() / TASK_ROWS)
    if tasks > 1:
        logged = logged.repartition(tasks)
    scaled = logged.withColumns({f"_{c}": scaler.column(c) + 1.0 for c in CLUSTER_FEATURES})
    names = [f"_{c}" for c in CLUSTER_FEATURES]
    return assemble(scaled, names).drop(*names)


#: Seeds of the restarts.
RESTARTS = tuple(range(42, 52))


def best_fits(df: DataFrame, ks: Iterable[int], seeds: tuple[int, ...] = RESTARTS) -> dict[int, KMeansModel]:
    """For each number of clusters the fit of least cost over several seeds. Fits run at the same time."""
    held = df.select("features").persist()
    fits = together(df.sparkSession, {
        (k, s): lambda k=k, s=s: KMeans(k=k, seed=s, initMode="k-means||").fit(held) for k in ks for s in seeds})
    held.unpersist()
    return {k: min((fits[k, s] for s in seeds), key=lambda m: m.summary.trainingCost) for k in ks}


def fit_kmeans(df: DataFrame, k: int = 5, seeds: tuple[int, ...] = RESTARTS) -> KMeansModel:
    """The fit of least cost over several seeds."""
    return best_fits(df, [k], seeds)[k]


def elbow(df: DataFrame, ks: range = range(2, 9), seeds: tuple[int, ...] = RESTARTS) -> DataFrame:
    """Inertia per number of clusters."""
    rows = [(k, float(model.summary.trainingCost)) for k, model in best_fits(df, ks, seeds).items()]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def fit_bisecting(df: DataFrame, k: int = 7, seed: int = 42):
    return BisectingKMeans(k=k, seed=seed).fit(df)


def assign(df: DataFrame, model) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", "cluster").drop("features")


def cluster_profile(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Size and mean of each column per cluster."""
    return df.groupBy(cluster).agg(
        F.count("*").alias("size"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
