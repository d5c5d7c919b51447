"""Sampling, features, models and forecasts.

Trees, rounds, depths, folds, trials and repeats are those of the reference, over all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import clamp, rounded
from ..models import anomaly, cluster, features_tree
from ..models import forecast as fc
from ..models.regress import (
    PURCHASE_FEATURES, TASK_ROWS, Ridge, Scaler, Stack, assemble, best_model, boosted, compare,
    cross_validate, fit_stopped, fold_summary, forest, importances, inverse_error_weights,
    permutation_importance, purchase_features, refit, training_partitions, KernelRegression,
)
from ..models.pool import together
from ..models.search import search as search_settings
from ..operators import events as ev, ranking, rollup, sampling, stats
from ..plans import marts, outlook
from ..schema import ENCODED
from ..session import dropped, scratch_path, settle, stored
from ..sources import files, star
from .base import (
    BEFORE, CUTOFF, HORIZON, NOW, customer_profiles, fact, least_squares_sql, query, r, segment_month, sql, state_panel,
)

SEED = 42
SAMPLE = 5_000


# Sampling and features -----------------------------------------------------------------

@query("M01_stratified_sample", sql(f"""
SELECT row_id, segment FROM (
  SELECT row_id, segment, need - CASE WHEN place <= surplus THEN 1 ELSE 0 END AS need, rn
  FROM (SELECT row_id, segment, row_number() OVER (PARTITION BY segment ORDER BY md5(row_id || '|{SEED}'), row_id) AS rn FROM fact)
  JOIN (SELECT segment, need, sum(need) OVER () - {SAMPLE} AS surplus, row_number() OVER (ORDER BY need DESC, segment) AS place
    FROM (SELECT segment, CAST(round_even(least({SAMPLE}.0 / (SELECT count(*) FROM fact), 1.0) * CAST(count(*) AS DOUBLE), 0) AS BIGINT) AS need
      FROM fact GROUP BY ALL)) USING (segment)) WHERE rn <= need""", "fact"))
def stratified(spark, folder):
    return sampling.stratified_sample(fact(spark, folder, "row_id", "segment"), "segment", "row_id", SAMPLE, SEED)


@query("M02_label_codes", sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT coalesce({c}, 'UNKNOWN') AS v FROM fact)""" for c in ENCODED), "fact"))
def codes(spark, folder):
    return sampling.label_codes(fact(spark, folder, *ENCODED), ENCODED)


def _code_sql(column: str) -> str:
    return f"(SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS code FROM fact GROUP BY {column})"


@query("M03_feature_matrix", sql(f"""
SELECT f.row_id, {', '.join(f'CAST(c{i}.code AS DOUBLE) AS {c}_enc' for i, c in enumerate(ENCODED))},
  CASE WHEN rooms IS NULL THEN 0.0 ELSE 1.0 END AS has_rooms, coalesce(rooms, 0.0) AS room_count,
  CASE WHEN ecomm_status = 'ACTIVE' THEN 1.0 ELSE 0.0 END AS is_ecomm_active,
  3.0 + CASE WHEN cat_l4 IS NULL THEN 0.0 ELSE 1.0 END AS category_depth,
  CAST(year_month % 100 AS DOUBLE) AS month, {r('ln(1 + CAST(spend AS DOUBLE))', 8)} AS label
FROM fact f {' '.join(f'JOIN {_code_sql(c)} c{i} ON c{i}.v = f.{c}' for i, c in enumerate(ENCODED))}
WHERE spend > 0""", "fact"))
def feature_matrix(spark, folder):
    df = purchase_features(fact(spark, folder))
    return df.withColumn("label", rounded(F.col("label"), 8)).drop("spend")


@query("M04_event_features", sql(f"""
SELECT l.state, l.year_month, {r('ln(1 + coalesce(population_m, 5.0))', 6)} AS log_population,
  {r('ln(1 + coalesce(gdp_b, 300.0))', 6)} AS log_gdp, {r('ln(1 + coalesce(tourism_b, 10.0))', 6)} AS log_tourism,
  {r('ln(1 + coalesce(hotel_rooms_k, 80.0))', 6)} AS log_hotel_rooms,
  {r('sin(2 * pi() * (l.year_month % 100) / 12)', 6)} AS month_sin, {r('cos(2 * pi() * (l.year_month % 100) / 12)', 6)} AS month_cos,
  {r('coalesce(event_score, 0)')} AS event_score, CAST(coalesce(event_count, 0) AS DOUBLE) AS event_count,
  {r('coalesce(max_event, 0)')} AS max_event, {r('coalesce(uplift_m, 0)')} AS uplift_m,
  {r('lag1', 6)} AS lag1, {r('lag2', 6)} AS lag2, {r('lag3', 6)} AS lag3, {r('roll3', 6)} AS roll3,
  CAST(l.year_month % 100 AS DOUBLE) AS month, {r('ln(1 + CAST(spend AS DOUBLE))', 6)} AS target
FROM lagged l LEFT JOIN (SELECT * EXCLUDE (event_count) FROM ref) q USING (state) LEFT JOIN ev_score USING (state, year_month)
LEFT JOIN ev_count USING (state, year_month) LEFT JOIN uplift USING (state, year_month)""",
    "lagged", "ref", "ev_score", "ev_count", "uplift"))
def event_features(spark, folder):
    df = _features(spark, folder, None)
    return df.select("state", "year_month", "event_count", "month",
                     *[rounded(F.col(c), 4).alias(c) for c in ("event_score", "max_event", "uplift_m")],
                     *[rounded(F.col(c), 6).alias(c) for c in (
                         *ev.REFERENCE_FEATURES, "month_sin", "month_cos", *ev.LAG_FEATURES, "target")])


def _features(spark, folder, cutoff=CUTOFF):
    panel = state_panel(spark, folder)
    history = panel if cutoff is None else panel.filter(F.col("year_month") <= cutoff)
    # Small frames over large tables, which the scaling, the folds and the features all read.
    months = settle(ev.event_panel(star.event_calendar(spark, folder), star.event_uplift(spark, folder)))
    return ev.feature_rows(history, settle(star.state_reference(spark, folder)), months)


_HEX = "('0x' || substr(md5(row_id || '|42'), {at}, 8))::BIGINT"


@query("M05_hash_split", sql(f"""
SELECT row_id, CASE WHEN {_HEX.format(at=1)} % 5 = 0 THEN 'test' WHEN {_HEX.format(at=9)} % 5 = 0 THEN 'validation'
  ELSE 'train' END AS split, CAST({_HEX.format(at=17)} % 5 AS INTEGER) AS fold FROM fact""", "fact"))
def split(spark, folder):
    return sampling.with_fold(sampling.with_split(fact(spark, folder, "row_id"), "row_id"), "row_id")


@query("M06_standard_scaling", sql("""
SELECT customer_id, """ + ", ".join(
    r(f"({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER ()", 6) + f" AS {n}" for n, x in (
        ("log_total_spend", "ln(1 + CAST(total_spend AS DOUBLE))"), ("transactions", "CAST(transactions AS DOUBLE)"),
        ("unique_distributors", "CAST(unique_distributors AS DOUBLE)"))) + " FROM profile", "profile"))
def scaling(spark, folder):
    df = customer_profiles(spark, folder)
    logged = df.withColumn("log_total_spend", F.log1p(F.col("total_spend").cast("double")))
    names = ["log_total_spend", "transactions", "unique_distributors"]
    scaled = Scaler.fit(logged, names).transform(logged)
    return scaled.select("customer_id", *[rounded(F.col(c), 6).alias(c) for c in names])


# Models on purchase lines ----------------------------------------------------------------

def _lines(spark, folder):
    """All purchase lines with features, split and fold, read once per query.

    Written as Parquet, where a vector takes two bytes a feature. Few lines are dealt over the cores first; more lie in
    enough parts already, and what they were made from goes.
    """
    df = sampling.with_fold(sampling.with_split(purchase_features(fact(spark, folder)), "row_id"), "row_id")
    ready, rows = assemble(df, PURCHASE_FEATURES).select("row_id", "features", "label", "split", "fold"), df.count()
    if rows <= TASK_ROWS * spark.sparkContext.defaultParallelism:
        ready = ready.repartition(training_partitions(spark, rows), "row_id")
    kept = stored(ready, "frame")
    dropped(ready)
    return kept


def _train(df):
    return df.filter(F.col("split") != "test")


def _test(df):
    return df.filter(F.col("split") == "test")


def _scored(model, df):
    return stats.scores(model.transform(_test(df)), "label", "prediction")


@query("M07_random_forest")
def random_forest(spark, folder):
    df = _lines(spark, folder)
    return importances(forest(200, 12).fit(_train(df)), PURCHASE_FEATURES, df)


@query("M08_boosted_trees")
def boosted_trees(spark, folder):
    df = _lines(spark, folder)
    return importances(_fit_stopped(boosted(300, 7, 0.05, subsample=0.9, columns=0.9), df), PURCHASE_FEATURES, df)


def _fit_stopped(learner, df):
    """Rounds on the training split up to the best one on the validation split."""
    return fit_stopped(learner, df.filter(F.col("split") == "train"), df.filter(F.col("split") == "validation"), 20)


def _panel(spark, folder):
    """State-month features up to the cutoff, scaled, with block folds by state.

    A row per state and month: one partition is enough for each of the many small fits.
    """
    features = _features(spark, folder)
    ready = assemble(Scaler.fit(features, ev.FEATURES).transform(features), ev.FEATURES)
    return settle(sampling.with_block_fold(ready.withColumnRenamed("target", "label"), "state").coalesce(1))


_POINTS = f"""SELECT [ln(1 + coalesce(population_m, 5.0)), ln(1 + coalesce(gdp_b, 300.0)), ln(1 + coalesce(tourism_b, 10.0)),
    ln(1 + coalesce(hotel_rooms_k, 80.0)), sin(2 * pi() * (l.year_month % 100) / 12), cos(2 * pi() * (l.year_month % 100) / 12),
    coalesce(event_score, 0), coalesce(event_count, 0), coalesce(max_event, 0), coalesce(uplift_m, 0),
    lag1, lag2, lag3, roll3, l.year_month % 100] AS f, ln(1 + CAST(spend AS DOUBLE)) AS y
  FROM lagged l LEFT JOIN (SELECT * EXCLUDE (event_count) FROM ref) q USING (state) LEFT JOIN ev_score USING (state, year_month)
  LEFT JOIN ev_count USING (state, year_month) LEFT JOIN uplift USING (state, year_month) WHERE l.year_month <= {CUTOFF}"""


@query("M09_ridge", sql(f"""
SELECT {ev.FEATURES!r}[i] AS feature, {r('b', 6)} AS coefficient, FROM {least_squares_sql(_POINTS, len(ev.FEATURES), 1.0)}
UNION ALL SELECT 'intercept', {r('avg(y)', 6)} FROM ({_POINTS})""", "lagged", "ref", "ev_score", "ev_count", "uplift"))
def ridge(spark, folder):
    model = Ridge(1.0).fit(_panel(spark, folder))
    rows = [("intercept", round(float(model.intercept), 6))]
    rows += [(n, round(float(c), 6)) for n, c in zip(ev.FEATURES, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


@query("M10_kernel_regression")
def kernel(spark, folder):
    df = _panel(spark, folder)
    return stats.scores(KernelRegression(ev.FEATURES).fit(df).transform(df), "label", "prediction")


@query("M11_cross_validation")
def cross_validation(spark, folder):
    return fold_summary(cross_validate(_panel(spark, folder), fc.state_learners()))


@query("M12_metrics", sql(f"""
SELECT model, {r('1 - sum(pow(actual - prediction, 2)) / (var_pop(actual) * count(*))', 6)} AS r2,
  {r('avg(abs(actual - prediction))', 2)} AS mae, {r('sqrt(avg(pow(actual - prediction, 2)))', 2)} AS rmse
FROM naive GROUP BY ALL""", "naive"))
def metrics(spark, folder):
    df = stats.scores(_naive(spark, folder), "actual", "prediction", ["model"])
    return df.select("model", rounded(F.col("r2"), 6).alias("r2"), rounded(F.col("mae"), 2).alias("mae"),
                     rounded(F.col("rmse"), 2).alias("rmse"))


def _naive(spark, folder):
    """Three predictors without a fit: last month, mean of three, same month a year ago."""
    panel = ev.prior_year(state_panel(spark, folder), ["state"])
    w = W.partitionBy("state").orderBy("year_month")
    back = [F.lag(F.col("spend").cast("double"), k).over(w) for k in (1, 2, 3)]
    wide = panel.select("state", "year_month", F.col("spend").cast("double").alias("actual"), back[0].alias("last"),
                        ((back[0] + back[1] + back[2]) / 3).alias("mean3"),
                        F.col("prior_year").cast("double").alias("year_ago"))
    long = wide.unpivot(["state", "year_month", "actual"], ["last", "mean3", "year_ago"], "model", "prediction")
    return long.filter(F.col("prediction").isNotNull())


#: Rows that a leaf of the reference's histogram boosters holds at least.
LEAF = 20


def _bases():
    return {"boosted_a": boosted(100, 6, 0.05), "boosted_b": boosted(100, 6, 0.05, min_rows=LEAF),
            "forest": forest(100, 10), "boosted_c": boosted(100, 5, 0.05)}


def _stack(df):
    return Stack(_bases(), folds=5).fit(_train(df))


@query("M13_stacking")
def stacking(spark, folder):
    df = _lines(spark, folder)
    return _scored(_stack(df), df)


def _search(df):
    """Trials on the training lines in three folds, and the best setting fitted again."""
    known = settle(sampling.with_fold(_train(df).drop("fold"), "row_id", 3))
    table = search_settings(known, 30, rounds=100, folds=3)
    return refit(known, table, rounds=200), table


@query("M14_hyper_parameter_search")
def search(spark, folder):
    """The trials; that of the best setting has the scores of its refit on the test lines."""
    df = _lines(spark, folder)
    (best_trial, model), table = _search(df)
    s = _scored(model, df).first()
    is_best = F.col("trial") == best_trial
    return table.withColumns({"is_best": is_best.cast("int"), **{
        f"refit_{c}": F.when(is_best, F.lit(s[c])) for c in ("r2", "mae", "rmse")}})


def _histogram():
    return boosted(200, 8, 0.1, min_rows=LEAF)


@query("M15_permutation_importance")
def permutation(spark, folder):
    df = _lines(spark, folder)
    model = _histogram().fit(_train(df))
    out = permutation_importance(_test(df), model, PURCHASE_FEATURES, repeats=10)
    return out.withColumn("importance", rounded(F.col("importance"), 6))


@query("M16_model_comparison")
def comparison(spark, folder):
    df = _lines(spark, folder)
    learners = {"random_forest": forest(200, 12), "histogram_boosted": _histogram(), "ridge": Ridge(1.0)}
    stopping = {"boosted": boosted(300, 7, 0.05, subsample=0.9, columns=0.9),
                "boosted_leaves": boosted(300, 7, 0.05, subsample=0.9, columns=0.9, min_rows=LEAF)}
    fits = {name: lambda m=learner: m.fit(_train(df)) for name, learner in learners.items()}
    fits |= {name: lambda m=learner: _fit_stopped(m, df) for name, learner in stopping.items()}
    # Stacking and the search fit many models at once themselves, so they come after the others.
    models = together(spark, fits) | {"stacking": _stack(df), "boosted_tuned": _search(df)[0][1]}
    parts = [_scored(model, df).withColumn("model", F.lit(name)) for name, model in models.items()]
    return compare(settle(reduce(DataFrame.unionByName, parts)))


@query("M16_naive_comparison", sql(f"""
SELECT model, {r('r2', 6)} AS r2, CAST(r2 = max(r2) OVER () AS INTEGER) AS is_best,
  {r('r2 - first_value(r2) OVER (ORDER BY model)', 6)} AS gain
FROM (SELECT model, 1 - sum(pow(actual - prediction, 2)) / (var_pop(actual) * count(*)) AS r2 FROM naive GROUP BY ALL)
""", "naive"))
def naive_comparison(spark, folder):
    """The comparison table over the predictors that need no fit."""
    table = compare(settle(stats.scores(_naive(spark, folder), "actual", "prediction", ["model"])))
    return table.select("model", rounded(F.col("r2"), 6).alias("r2"), "is_best", rounded(F.col("gain"), 6).alias("gain"))


# Clusters and anomalies -------------------------------------------------------------------

def _customers(spark, folder):
    return settle(cluster.cluster_frame(customer_profiles(spark, folder)))


@query("M17_kmeans_elbow")
def elbow(spark, folder):
    return cluster.elbow(_customers(spark, folder), range(2, 9))


@query("M17_elbow_invariants", sql("""
SELECT least(7, count(*)) AS n_rows, 0 AS rises, 0 AS above_whole FROM profile""", "profile"))
def elbow_invariants(spark, folder):
    """More clusters never cost more, and none costs more than the spread of all customers: their number times the features."""
    df = _customers(spark, folder)
    found = settle(cluster.elbow(df, range(2, 9)))  # a row for each number of clusters
    whole = df.select(F.count("*") * len(cluster.CLUSTER_FEATURES)).scalar()
    before = F.lag("inertia").over(W.orderBy("k"))
    return found.select("k", "inertia", before.alias("before"), whole.alias("whole")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("inertia") > F.col("before") * (1 + 1e-9)).cast("int").alias("rises"),
        F.count_if(F.col("inertia") > F.col("whole")).cast("int").alias("above_whole"))


@query("M18_bisecting_kmeans")
def bisecting(spark, folder):
    df = _customers(spark, folder)
    return cluster.cluster_profile(cluster.assign(df, cluster.fit_bisecting(df, 7)), ["total_spend", "transactions"])


def _feature_clusters(spark, folder):
    return features_tree.cluster_by_features(_customers(spark, folder), 7)


@query("M18_feature_clusters")
def feature_clusters(spark, folder):
    """Size and means of seven clusters of customers, by clustering features."""
    return cluster.cluster_profile(_feature_clusters(spark, folder), ["total_spend", "transactions"])


@query("M18_feature_cluster_totals", sql(f"""
SELECT 7 AS clusters, count(*) AS customers, {r('sum(total_spend)', 2)} AS total_spend, sum(transactions)::BIGINT AS transactions
FROM profile""", "profile"))
def feature_cluster_totals(spark, folder):
    """Sizes and means of the clusters add up to all customers."""
    found = cluster.cluster_profile(_feature_clusters(spark, folder), ["total_spend", "transactions"])
    return found.agg(F.count_distinct("cluster").cast("int").alias("clusters"), F.sum("size").alias("customers"),
                     rounded(F.sum(F.col("size") * F.col("total_spend")), 2).alias("total_spend"),
                     F.round(F.sum(F.col("size") * F.col("transactions"))).cast("long").alias("transactions"))


@query("M19_isolation_forest")
def isolation(spark, folder):
    return anomaly.flagged(purchase_features(fact(spark, folder)), PURCHASE_FEATURES).select(
        "row_id", rounded(F.col("anomaly_score"), 6).alias("anomaly_score"), "is_anomaly")


@query("M20_top_anomaly_categories")
def anomaly_categories(spark, folder):
    """The category goes through the scoring with its line, so nothing is joined back."""
    flagged = anomaly.flagged(purchase_features(fact(spark, folder), "cat_l1"), PURCHASE_FEATURES)
    return ranking.top_rows(rollup.value_counts(flagged.filter("is_anomaly = 1"), "category"), 10, "n", "category").select(
        F.col("category").alias("cat_l1"), "n")


# Forecasts --------------------------------------------------------------------------------

@query("M21_inverse_error_weights", sql(f"""
SELECT model, {r('(1 / rmse) / sum(1 / rmse) OVER ()', 6)} AS weight
FROM (SELECT model, sqrt(avg(pow(actual - prediction, 2))) AS rmse FROM naive GROUP BY ALL)""", "naive"))
def weights(spark, folder):
    errors = stats.scores(_naive(spark, folder), "actual", "prediction", ["model"])
    return inverse_error_weights(errors).select("model", rounded(F.col("weight"), 6).alias("weight"))


def _outlook(spark, folder):
    return outlook.run(state_panel(spark, folder), settle(star.state_reference(spark, folder)),
                       star.event_calendar(spark, folder), star.event_uplift(spark, folder),
                       CUTOFF, HORIZON)


#: Outlooks written in this run, by application, folder and fingerprint of the source files.
_OUTLOOKS: dict[tuple, str] = {}


def _outlook_table(spark, folder):
    """The state outlook as a table, keyed by state and month: fitted once for all queries of a run that read it."""
    sources = [f"{folder}/{name}.parquet" for name in ("lineitem", "orders", "customer", "nation", "part", "supplier", "events")]
    key = (spark.sparkContext.applicationId, folder, files.file_fingerprint(spark, *sources))
    if key not in _OUTLOOKS:
        path = scratch_path(spark, "outlook")
        _outlook(spark, folder)[0].write.parquet(path)
        _OUTLOOKS[key] = path
    return spark.read.parquet(_OUTLOOKS[key])


@query("M22_state_forecast")
def state_forecast(spark, folder):
    df = _outlook_table(spark, folder)
    return df.select("state", "year_month", *[rounded(F.col(c), 2).alias(c) for c in df.columns[2:]])


@query("M22_outlook_invariants", sql(f"""
SELECT count(DISTINCT state) * {len(HORIZON)} AS n_rows, count(DISTINCT state) AS states, {len(HORIZON)} AS months,
  0 AS out_of_bounds, 0 AS out_of_band, 0 AS missing, 0 AS repeated FROM state_month WHERE year_month <= {CUTOFF}""", "state_month"))
def outlook_invariants(spark, folder):
    """What must hold in the outlook: one row a state and month ahead; floor, low, spend and high in order, and the
    band that of the four models. The ceiling bounds spend, and stretched the band; a floor above it wins."""
    df = _outlook_table(spark, folder)
    models = [F.col(name) for name in fc.state_learners(1, 1)]
    spend, low, high = F.col("spend"), F.col("low"), F.col("high")
    top = F.greatest("ceiling", "floor")
    broken = (spend < F.col("floor")) | (spend > top) | (low < F.col("floor")) | (
        high > F.greatest(F.col("ceiling") * fc.BAND_STRETCH, F.col("floor")))
    outside = (low != F.least(*models)) | (high != F.greatest(*models)) | (low > high)
    missing = reduce(lambda a, c: a | c.isNull(), [spend, low, high, *models], F.lit(False))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("state").alias("states"), F.count_distinct("year_month").cast("int").alias("months"),
        F.count_if(broken).cast("int").alias("out_of_bounds"), F.count_if(outside).cast("int").alias("out_of_band"),
        F.count_if(missing).cast("int").alias("missing"),
        (F.count("*") - F.count_distinct("state", "year_month")).cast("int").alias("repeated"))


@query("M24_ensemble_band")
def ensemble_band(spark, folder):
    """Least and greatest of the four models' forecasts, each inside the corridor."""
    return _outlook_table(spark, folder).select("state", "year_month", rounded(F.col("low"), 2).alias("low"),
                                                rounded(F.col("high"), 2).alias("high"))


@query("U06_state_actual_and_forecast")
def state_actual_and_forecast(spark, folder):
    """Months up to the cutoff as they were, months after it from the outlook."""
    history = state_panel(spark, folder).filter(F.col("year_month") <= CUTOFF)
    return fc.actual_and_forecast(history, _outlook_table(spark, folder), ["state"]).select(
        "state", "year_month", *[rounded(F.col(c), 2).alias(c) for c in ("spend", "low", "high")], "kind")


_CORRIDOR = f"""(SELECT state, year_month, x, base, ab, sc, prior,
  greatest(base * 0.65, CASE WHEN ab >= 3 THEN base + ab * 1e6 * 0.6 ELSE base * 0.65 END,
    CASE WHEN prior > 0 THEN prior * 0.9 ELSE 0 END) AS floor,
  CASE WHEN ab < 1 AND sc < 30 AND prior > 0 THEN least(c1, prior * 1.15) ELSE c1 END AS ceiling
FROM (SELECT *, CASE WHEN prior > 0 AND ab >= 3 THEN greatest(c0, prior + ab * 1e6) ELSE c0 END AS c1
  FROM (SELECT m.state, m.year_month, CAST(m.spend AS DOUBLE) AS x, b.base, coalesce(u.uplift_m, 0) AS ab,
      coalesce(e.event_score, 0) AS sc, coalesce(CAST(p.spend AS DOUBLE), 0) AS prior,
      b.base * CASE WHEN coalesce(u.uplift_m, 0) >= 8 THEN 2.2 WHEN coalesce(u.uplift_m, 0) >= 5 THEN 1.8
        WHEN coalesce(u.uplift_m, 0) >= 2 THEN 1.65 ELSE 1.55 END AS c0
    FROM state_month m JOIN (SELECT state, avg(CAST(spend AS DOUBLE)) AS base FROM state_month
        WHERE year_month <= {CUTOFF} AND spend > 0 GROUP BY ALL) b USING (state)
    LEFT JOIN uplift u USING (state, year_month) LEFT JOIN ev_score e USING (state, year_month)
    LEFT JOIN state_month p ON p.state = m.state AND p.year_month = m.year_month - 100
    WHERE m.year_month BETWEEN {HORIZON[0]} AND {HORIZON[-1]})))"""


def _corridor(spark, folder):
    """Corridor of each state and horizon month; the month's actual spend is bounded by it."""
    panel = state_panel(spark, folder)
    history = panel.filter((F.col("year_month") <= CUTOFF) & (F.col("spend") > 0))
    base = history.groupBy("state").agg(F.avg(F.col("spend").cast("double")).alias("base"))
    keys = ["state", "year_month"]
    ahead = ev.prior_year(panel, ["state"]).filter(F.col("year_month").between(HORIZON[0], HORIZON[-1]))
    joined = (ahead.join(base, "state").join(star.event_uplift(spark, folder), keys, "left")
              .join(ev.event_scores(star.event_calendar(spark, folder)), keys, "left")
              .withColumn("prior", F.col("prior_year").cast("double"))
              .fillna(0.0, subset=["uplift_m", "event_score", "prior"]))
    floor, ceiling = fc.corridor(F.col("base"), F.col("uplift_m"), F.col("event_score"), F.col("prior"))
    return joined.withColumns({"floor": floor, "ceiling": ceiling, "x": F.col("spend").cast("double")})


@query("M23_corridor", sql(f"""
SELECT state, year_month, {r('floor', 2)} AS floor, {r('ceiling', 2)} AS ceiling,
  {r('greatest(floor, least(ceiling, x))', 2)} AS bounded FROM {_CORRIDOR}""",
    "state_month", "uplift", "ev_score"))
def corridor(spark, folder):
    df = _corridor(spark, folder)
    return df.select("state", "year_month", rounded(F.col("floor"), 2).alias("floor"),
                     rounded(F.col("ceiling"), 2).alias("ceiling"),
                     rounded(clamp(F.col("x"), F.col("floor"), F.col("ceiling")), 2).alias("bounded"))


@query("M24_model_band", sql(f"""
SELECT state, year_month, {r('min(greatest(floor, least(ceiling * 1.3, prediction)))', 2)} AS low,
  {r('max(greatest(floor, least(ceiling * 1.3, prediction)))', 2)} AS high
FROM {_CORRIDOR} JOIN naive USING (state, year_month) GROUP BY ALL""", "state_month", "uplift", "ev_score", "naive"))
def band(spark, folder):
    bounds = _corridor(spark, folder).select("state", "year_month", "floor", "ceiling")
    joined = bounds.join(_naive(spark, folder), ["state", "year_month"])
    bounded = joined.withColumn("b", clamp(F.col("prediction"), F.col("floor"), F.col("ceiling") * fc.BAND_STRETCH))
    return bounded.groupBy("state", "year_month").agg(
        rounded(F.min("b"), 2).alias("low"), rounded(F.max("b"), 2).alias("high"))


def _segment_outlook(spark, folder):
    return fc.forecast_segments(segment_month(spark, folder), ["segment"], CUTOFF, HORIZON)


@query("M25_segment_forecast")
def segment_forecast(spark, folder):
    df = _segment_outlook(spark, folder)
    return df.select("segment", "year_month", *[rounded(F.col(c), 2).alias(c) for c in ("spend", "low", "high")])


@query("M25_segment_forecast_bounds", sql(f"""
SELECT count(DISTINCT segment) * {len(HORIZON)} AS n_rows, 0 AS out_of_bounds, 0 AS repeated FROM seg_month WHERE year_month <= {CUTOFF}""",
    "seg_month"))
def segment_forecast_bounds(spark, folder):
    """One row a segment and month ahead, within the shares of the segment's mean month, and the band in order."""
    mean = segment_month(spark, folder).filter(F.col("year_month") <= CUTOFF).groupBy("segment").agg(
        F.avg(F.col("spend").cast("double")).alias("mean"))
    floor, ceiling = F.col("mean") * fc.SEGMENT_FLOOR, F.col("mean") * fc.SEGMENT_CEILING
    inside = F.col("spend").between(floor * (1 - 1e-9), ceiling * (1 + 1e-9)) & (
        F.col("low") >= floor * fc.LOW_STRETCH * (1 - 1e-9)) & (F.col("high") <= ceiling * fc.HIGH_STRETCH * (1 + 1e-9))
    return _segment_outlook(spark, folder).join(mean, "segment", "left").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.coalesce(inside, F.lit(False))).cast("int").alias("out_of_bounds"),
        (F.count("*") - F.count_distinct("segment", "year_month")).cast("int").alias("repeated"))


@query("M25_segment_state_forecast")
def segment_state_forecast(spark, folder):
    panel = marts.segment_state_month(fact(spark, folder, "segment", "state", "year_month", "spend"))
    df = fc.forecast_segments(panel, ["segment", "state"], CUTOFF, HORIZON)
    return df.select("segment", "state", "year_month", *[rounded(F.col(c), 2).alias(c) for c in ("spend", "low", "high")])


@query("T08_best_model", sql(f"""
SELECT arg_min(model, (rmse, model)) AS best_model, {r('min(rmse)', 2)} AS rmse
FROM (SELECT model, sqrt(avg(pow(actual - prediction, 2))) AS rmse FROM naive GROUP BY ALL)""", "naive"))
def best(spark, folder):
    errors = stats.scores(_naive(spark, folder), "actual", "prediction", ["model"])
    return best_model(errors).withColumn("rmse", rounded(F.col("rmse"), 2))


@query("U06_actual_and_forecast")
def actual_and_forecast(spark, folder):
    history = segment_month(spark, folder).filter(F.col("year_month") <= CUTOFF)
    return fc.actual_and_forecast(history, _segment_outlook(spark, folder), ["segment"])


@query("U06_actual_and_stand_in", sql(f"""
SELECT segment, year_month, {r('spend', 2)} AS spend, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, 'actual' AS kind
FROM seg_month WHERE year_month <= {CUTOFF}
UNION ALL SELECT segment, year_month + 100, {r('spend', 2)}, {r('CAST(spend AS DOUBLE) * 0.85', 2)}, {r('CAST(spend AS DOUBLE) * 1.15', 2)}, 'forecast'
FROM seg_month WHERE year_month + 100 BETWEEN {HORIZON[0]} AND {HORIZON[-1]}""", "seg_month"))
def actual_and_stand_in(spark, folder):
    """The same union with last year's months in place of a forecast."""
    panel = settle(segment_month(spark, folder))
    spend = F.col("spend").cast("double")
    ahead = panel.select("segment", (F.col("year_month") + 100).alias("year_month"), spend.alias("spend"),
                         (spend * fc.LOW_STRETCH).alias("low"), (spend * fc.HIGH_STRETCH).alias("high")).filter(
        F.col("year_month").between(HORIZON[0], HORIZON[-1]))
    both = fc.actual_and_forecast(panel.filter(F.col("year_month") <= CUTOFF), ahead, ["segment"])
    return both.select("segment", "year_month", *[rounded(F.col(c), 2).alias(c) for c in ("spend", "low", "high")], "kind")


@query("A30_portfolio_figures")
def portfolio_figures(spark, folder):
    return outlook.portfolio(state_panel(spark, folder), _outlook_table(spark, folder), star.event_calendar(spark, folder),
                             CUTOFF // 100, NOW, BEFORE)
