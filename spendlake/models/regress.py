"""Regression: features, scaling, learners, validation, stacking, search, importance."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import month_of
from ..operators.clean import category_depth, positive_spend, purchase_flags
from ..operators.permutation import permuted
from ..operators.ranking import with_position
from ..operators.sampling import encode_labels
from ..operators.stats import scores
from ..schema import CATEGORY_LEVELS, ENCODED
from ..session import settle, stored
from .pool import AT_ONCE, together
from .swapped import Walks, squared_errors, with_digits
from .trees import GBTRegressor, RandomForestRegressor

PURCHASE_FEATURES = [f"{c}_enc" for c in ENCODED] + [
    "has_rooms", "room_count", "is_ecomm_active", "category_depth", "month"]


#: Rows of a training frame that one task holds.
TASK_ROWS = 1_000_000


def purchase_features(fact: DataFrame, category: str | None = None) -> DataFrame:
    """Purchase lines -> ``row_id``, the model features (null as 0) and log1p spend.

    A named column comes along unencoded as ``category``. The lines are joined and written once, for the
    label codes and for all that reads the features.
    """
    named = [F.col(category).alias("category")] if category else []
    needed = dict.fromkeys(["row_id", "spend", *ENCODED, *CATEGORY_LEVELS, "rooms", "year_month"])
    kept = stored(positive_spend(fact).select(*needed, *named), "lines")
    coded = encode_labels(purchase_flags(kept), ENCODED)
    full = coded.withColumns({"category_depth": category_depth(), "month": month_of("year_month")})
    return full.select(
        "row_id", "spend", *(["category"] if category else []),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PURCHASE_FEATURES],
        F.log1p(F.col("spend").cast("double")).alias("label"))


def training_partitions(spark: SparkSession, rows: int, fits: int = 1) -> int:
    """Partitions of a training frame: a task for every core, or a multiple of that for more than ``TASK_ROWS`` rows each.

    In every pass over the rows each task sends the statistics of all nodes that the pass grows, so tasks beyond the
    cores cost a shuffle of their own. Given as a number, so that adaptive execution does not merge what many passes will read.
    ``fits`` that run at once keep the cores busy with two tasks a core between them.
    """
    cores = spark.sparkContext.defaultParallelism
    tasks = min(cores, math.ceil(2 * cores / min(fits, AT_ONCE)))
    return tasks * max(1, math.ceil(rows / (tasks * TASK_ROWS)))


def for_fits(df: DataFrame, fits: int) -> DataFrame:
    """A written frame for ``fits`` at once: partitions are read together, without a shuffle, down to the tasks they need."""
    return df.coalesce(training_partitions(df.sparkSession, df.count(), fits))


def assemble(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=output).transform(df)


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature is only centred."""

    stats: dict[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, features: list[str]) -> Scaler:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{tag}_{c}") for c in features
                       for tag, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return Scaler({c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in features})

    def column(self, name: str, source: Column | None = None) -> Column:
        mean, deviation = self.stats[name]
        value = F.col(name).cast("double") if source is None else source
        return (value - F.lit(mean)) / F.lit(deviation)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.stats})


def forest(trees: int = 200, depth: int = 12, min_rows: int = 1, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows,
                                 featureSubsetStrategy="all", seed=seed, cacheNodeIds=True)


def boosted(rounds: int = 300, depth: int = 5, rate: float = 0.05, subsample: float = 1.0,
            columns: float = 1.0, min_rows: int = 1, validation: str | None = None,
            seed: int = 42) -> GBTRegressor:
    """Boosted trees on squared error. A validation column stops early.

    Every tree walks its rows down again in each pass: a tree of a round is small, and keeping the rows' nodes
    would write a frame of its own in every pass. The trees are the same.
    """
    model = GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
                         featureSubsetStrategy=str(float(columns)) if columns < 1 else "all",
                         minInstancesPerNode=min_rows, cacheNodeIds=False, seed=seed)
    return model.setValidationIndicatorCol(validation) if validation else model


def fit_stopped(learner: GBTRegressor, train: DataFrame, validation: DataFrame, patience: int = 20,
                first: int = 40) -> GBTRegressionModel:
    """The model up to its best round on the validation rows before ``patience`` rounds without a better one.

    Spark's own stop ends at the first round that gains less than a tolerance. Here a fit of ``first``
    rounds is judged, and only while it has not stopped, one of twice as many. Rounds depend
    on the seed and on earlier rounds only, so the result is that of all rounds cut at the same place,
    and no more than about twice the rounds up to the stop are ever fitted.
    """
    rounds, most = min(first, learner.getMaxIter()), learner.getMaxIter()
    while True:
        model = learner.copy({learner.maxIter: rounds}).fit(train)
        best = stop_round(model.evaluateEachIteration(validation, "squared"), patience)
        if rounds == most or rounds - best >= patience:
            return cut(model, best)
        rounds = min(2 * rounds, most)


def cut(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first rounds."""
    if rounds == model.getNumTrees:
        return model
    old, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    java = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(java.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = old.trees()[i], float(model.treeWeights[i])
    short = java.GBTRegressionModel(old.uid(), trees, weights)
    return GBTRegressionModel(old.copyValues(short, old.extractParamMap()))


def stopped(model: GBTRegressionModel, validation: DataFrame, patience: int) -> GBTRegressionModel:
    """A fitted model up to its best round on the validation rows."""
    return cut(model, stop_round(model.evaluateEachIteration(validation, "squared"), patience))


def stop_round(errors: list[float], patience: int) -> int:
    """Number of rounds up to the least error before ``patience`` rounds without a lower one.

    Without a row to judge by, errors are NaN and all rounds stay.
    """
    if math.isnan(errors[0]):
        return len(errors)
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


class Ridge:
    """Ridge with penalty ``alpha`` on the sum of squared errors, as an estimator to fit.

    Spark's objective is the mean error and scales the label, hence the penalty's form.
    """

    def __init__(self, alpha: float = 1.0, features: str = "features") -> None:
        self.alpha, self.features = alpha, features

    def fit(self, df: DataFrame) -> RidgeModel:
        row = df.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s"),
                     Summarizer.variance(F.col(self.features)).alias("v")).first()
        size = len(row["v"])
        varying = [i for i, v in enumerate(row["v"]) if v > 0]
        cut = None
        if len(varying) < size:
            cut = VectorSlicer(inputCol=self.features, outputCol="_varying", indices=varying)
        learner = LinearRegression(
            featuresCol="_varying" if cut else self.features, solver="normal", elasticNetParam=0.0,
            standardization=False, regParam=self.alpha * (row["s"] or 1.0) / row["n"])
        return RidgeModel(cut, learner.fit(cut.transform(df) if cut else df), varying, size)


class RidgeModel:
    """A fitted ridge. Constant features are left out of the fit, where they would make
    the normal equations singular, and have coefficient 0."""

    def __init__(self, cut: VectorSlicer | None, linear: Model, varying: list[int], size: int) -> None:
        self.cut, self.linear = cut, linear
        self.intercept = float(linear.intercept)
        self.coefficients = np.zeros(size)
        self.coefficients[varying] = linear.coefficients.toArray()

    def transform(self, df: DataFrame) -> DataFrame:
        if self.cut is None:
            return self.linear.transform(df)
        return self.linear.transform(self.cut.transform(df)).drop("_varying")


class FourierFeatures:
    """Random cosine features whose dot products approximate an RBF kernel.

    Built from array functions, so the mapping runs in the JVM.
    """

    def __init__(self, inputs: list[str], size: int = 64, gamma: float | None = None,
                 seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        gamma = gamma or 1.0 / len(inputs)
        weights = rng.normal(0.0, math.sqrt(2 * gamma), (size, len(inputs)))
        shift = rng.uniform(0.0, 2 * math.pi, (size, 1))
        self.inputs, self.size = inputs, size
        rows = np.hstack([weights, shift]).tolist()
        self.rows = "array(" + ", ".join(
            "array(" + ", ".join(f"{v!r}D" for v in row) + ")" for row in rows) + ")"

    def column(self, inputs: list[Column] | None = None) -> Column:
        columns = inputs or [F.col(c) for c in self.inputs]
        x = F.array(*[c.cast("double") for c in columns], F.lit(1.0))
        dot = lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0),
                                    lambda s, v: s + v)
        return array_to_vector(F.transform(
            F.expr(self.rows), lambda w: F.cos(dot(w)) * math.sqrt(2.0 / self.size)))


class KernelRegression:
    """Ridge on random cosine features; stands in for an RBF support vector fit.

    ``cost`` weighs the errors against the penalty. The normal equations need one pass.
    """

    def __init__(self, inputs: list[str], size: int = 64, cost: float = 10.0, seed: int = 42) -> None:
        self.map = FourierFeatures(inputs, size, seed=seed)
        self.linear = Ridge(1.0 / cost, "kernel")

    def fit(self, df: DataFrame) -> KernelModel:
        return KernelModel(self.map, self.linear.fit(df.withColumn("kernel", self.map.column())))


class KernelModel:
    def __init__(self, mapping: FourierFeatures, linear: Model) -> None:
        self.map, self.linear = mapping, linear

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear.transform(df.withColumn("kernel", self.map.column())).drop("kernel")


def importances(model: Model, features: list[str], df: DataFrame) -> DataFrame:
    """``feature, importance`` of a fitted tree model."""
    values = model.featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def fold_fits(df: DataFrame, learners: dict[str, object], fold: str = "fold", folds: int = 5) -> dict[tuple, object]:
    """What to fit for cross-validation: a task for each learner and fold, on the rows outside the fold."""
    return {(name, i): lambda learner=learner, i=i: learner.fit(df.filter(F.col(fold) != i))
            for name, learner in learners.items() for i in range(folds)}


def held_out(df: DataFrame, fitted: dict[tuple, object], name: str, fold: str = "fold") -> DataFrame:
    """Each row scored by the model of a learner that did not see its fold."""
    return reduce(DataFrame.unionByName, [
        model.transform(df.filter(F.col(fold) == i)) for (learner, i), model in fitted.items() if learner == name])


def out_of_fold(df: DataFrame, learner, fold: str = "fold", folds: int = 5) -> DataFrame:
    """Each row scored by a model that did not see its fold. Fits ``folds`` models at once."""
    return held_out(df, together(df.sparkSession, fold_fits(df, {"": learner}, fold, folds)), "", fold)


def fold_scores(df: DataFrame, fitted: dict[tuple, object], fold: str = "fold") -> DataFrame:
    """``model, fold, r2, mae, rmse`` of fits made by ``fold_fits``."""
    return reduce(DataFrame.unionByName, [
        scores(held_out(df, fitted, name, fold), "label", "prediction", [fold]).withColumn("model", F.lit(name))
        for name in dict.fromkeys(name for name, _ in fitted)])


def cross_validate(df: DataFrame, learners: dict[str, object], fold: str = "fold",
                   folds: int = 5) -> DataFrame:
    """Fold scores per learner: ``model, fold, r2, mae, rmse``. All learners and folds are fitted at once."""
    return fold_scores(df, together(df.sparkSession, fold_fits(df, learners, fold, folds)), fold)


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of R squared, and root of the mean squared error."""
    return folds.groupBy("model").agg(
        F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"),
        F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("rmse"))


def inverse_error_weights(errors: DataFrame, model: str = "model", error: str = "rmse") -> DataFrame:
    """Ensemble weight of each model: its share of the inverse errors."""
    inverse = errors.withColumn("_inv", F.try_divide(F.lit(1.0), F.col(error)))
    total = inverse.select(F.sum("_inv")).scalar()
    return inverse.withColumn("weight", F.col("_inv") / total).drop("_inv")


def best_model(errors: DataFrame, model: str = "model", error: str = "rmse") -> DataFrame:
    """The model of least error."""
    return errors.agg(F.min_by(model, F.struct(F.col(error), F.col(model))).alias("best_model"),
                      F.min(error).alias("rmse"))


def compare(metrics: DataFrame, score: str = "r2") -> DataFrame:
    """Metric table with a flag on the best row and the gain over the first model by name."""
    best = metrics.select(F.max(score)).scalar()
    first = metrics.select(F.min_by(score, "model")).scalar()
    return metrics.withColumns({"is_best": (F.col(score) == best).cast("int"), "gain": F.col(score) - first})


class Stack:
    """Base learners under a ridge. The ridge sees only out-of-fold predictions."""

    def __init__(self, learners: dict[str, object], folds: int = 3, alpha: float = 1.0) -> None:
        self.learners, self.folds, self.alpha = learners, folds, alpha

    def fit(self, df: DataFrame) -> StackModel:
        base = df.select("row_id", "features", "label", "fold")
        dealt = for_fits(base, len(self.learners) * (self.folds + 1))
        whole = {(n, None): lambda m=m: m.fit(dealt) for n, m in self.learners.items()}
        fitted = together(df.sparkSession, fold_fits(dealt, self.learners, folds=self.folds) | whole)
        bases = {n: fitted.pop((n, None)) for n in self.learners}
        meta = base.select("row_id", "label")
        for name in self.learners:
            meta = meta.join(held_out(base, fitted, name).select("row_id", F.col("prediction").alias(name)), "row_id")
        ready = assemble(meta, list(self.learners), "meta")
        return StackModel(bases, Ridge(self.alpha, "meta").fit(ready))


class StackModel:
    def __init__(self, bases: dict[str, Model], top: Model) -> None:
        self.bases, self.top = bases, top

    @property
    def weights(self) -> dict[str, float]:
        return dict(zip(self.bases, map(float, self.top.coefficients)))

    def transform(self, df: DataFrame) -> DataFrame:
        for name, model in self.bases.items():
            df = model.transform(df).withColumnRenamed("prediction", name)
        return self.top.transform(assemble(df, list(self.bases), "meta")).drop("meta", *self.bases)


# Search ranges.
SEARCH = {"depth": (4, 10), "rate": (0.01, 0.3), "subsample": (0.6, 1.0), "columns": (0.6, 1.0)}


def search_grid(trials: int = 30, seed: int = 42, depth: tuple[int, int] = SEARCH["depth"]) -> list[dict]:
    """Random settings within the ranges, the same for the same seed."""
    rng = random.Random(seed)
    return [{"depth": rng.randint(*depth), **{
        k: round(rng.uniform(*SEARCH[k]), 4) for k in ("rate", "subsample", "columns")}}
        for _ in range(trials)]


def tune(df: DataFrame, grid: list[dict], rounds: int = 100, folds: int = 3,
         parallelism: int = 4) -> tuple[CrossValidatorModel, DataFrame]:
    """Random search by cross-validated R squared over the ``fold`` column."""
    learner = boosted(rounds)
    maps = [{learner.maxDepth: g["depth"], learner.stepSize: g["rate"],
             learner.subsamplingRate: g["subsample"],
             learner.featureSubsetStrategy: str(g["columns"])} for g in grid]
    search = CrossValidator(estimator=learner, estimatorParamMaps=maps, numFolds=folds,
                            evaluator=RegressionEvaluator(metricName="r2"), foldCol="fold",
                            parallelism=parallelism)
    fitted = search.fit(df)
    rows = [(i, *map(float, g.values()), float(r2))
            for i, (g, r2) in enumerate(zip(grid, fitted.avgMetrics))]
    table = df.sparkSession.createDataFrame(
        rows, "trial int, depth double, rate double, subsample double, columns double, mean_r2 double")
    return fitted, table


def refit(df: DataFrame, trials: DataFrame, rounds: int = 200) -> tuple[int, Model]:
    """The trial of greatest R squared (the first, if tied), and its setting fitted on all rows."""
    best = trials.orderBy(F.desc("mean_r2"), "trial").first()  # a row a trial
    learner = boosted(rounds, int(best["depth"]), best["rate"], best["subsample"], best["columns"])
    return best["trial"], learner.fit(df)


def permutation_importance(df: DataFrame, model: Model, features: list[str], repeats: int = 10,
                           seed: int = 42) -> DataFrame:
    """Mean loss of R squared when one feature is shuffled.

    Rows are numbered once. In each repeat a keyed permutation of the numbers names every row's
    donor, so one join brings the donors of all repeats. Trees are walked once a row and repeat for all
    features (``swapped``). With any other model each row is scored once per repeat and feature with that
    one entry taken from the donor, in one pass.
    """
    base = df.select("row_id", "label", vector_to_array("features").alias("_x"))
    walks = Walks.of(model, len(features))
    if walks:
        base = with_digits(base, walks, "_x", "_x")
    placed = settle(with_position(base, ["row_id"], "_at"))
    n = placed.count()
    donors = F.posexplode(F.array(*[permuted(F.col("_at") - 1, n, seed + r) + 1 for r in range(repeats)])).alias(
        "_repeat", "_donor_at")
    pairs = placed.select("label", "_x", donors).join(
        placed.select(F.col("_at").alias("_donor_at"), F.col("_x").alias("_donor")), "_donor_at")
    if walks:
        whole = placed.select(F.var_pop("label") * F.count("label")).scalar()
        drops = squared_errors(pairs, walks, features, repeats).withColumn("r2", F.lit(1.0) - F.try_divide("_rss", whole))
    else:
        names = F.array(*[F.lit(f) for f in features])
        each = pairs.select("label", "_x", "_donor", "_repeat", F.posexplode(names).alias("_j", "feature"))
        mixed = F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.get("_donor", i)).otherwise(v))
        swapped = each.select("label", "feature", "_repeat", array_to_vector(mixed).alias("features"))
        drops = scores(model.transform(swapped), "label", "prediction", ["_repeat", "feature"])
    intact = scores(model.transform(df), "label", "prediction").select(F.col("r2")).scalar()
    means = drops.groupBy("feature").agg(F.avg("r2").alias("_shuffled"))
    return means.select("feature", (intact - F.col("_shuffled")).alias("importance"))


def align_importances(vectors: dict[str, DataFrame]) -> DataFrame:
    """Importance tables side by side by feature; a missing value is 0."""
    out = None
    for name, df in vectors.items():
        part = df.select("feature", F.col("importance").alias(name))
        out = part if out is None else out.join(part, "feature", "full")
    return out.fillna(0.0)
