"""Marts: equal totals across rollups, refresh by month, raw CSV."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from spendlake.operators import rollup
from spendlake.plans import explore, marts
from spendlake.sources import files, star


def fact(spark, folder):
    return star.spend_fact(spark, folder).filter(F.col("year_month").between(200001, 200006))


def test_build_keeps_totals(spark, folder, tmp_path):
    df = fact(spark, folder)
    marts.build(df, str(tmp_path))
    total = df.agg(F.sum("spend")).first()[0]
    for name in ("customer_month", "portfolio_month", "segment_month", "category_month", "state_month",
                 "segment_state_month"):
        assert files.read_mart(spark, os.path.join(tmp_path, name)).agg(F.sum("spend")).first()[0] == total
    ends = files.read_mart(spark, os.path.join(tmp_path, "concentration")).agg(
        F.max("cum_pct"), F.max("rank_pct")).first()
    assert abs(ends[0] - 100) < 1e-9 and ends[1] == 100.0
    features = files.read_mart(spark, os.path.join(tmp_path, "segment_features"))
    assert features.count() == 5 and features.agg(F.sum("total_spend")).first()[0] == total


def test_refresh_touches_only_its_months(spark, folder, tmp_path):
    df = fact(spark, folder)
    marts.build(df, str(tmp_path))
    path = os.path.join(tmp_path, "segment_month")
    before = {(r.segment, r.year_month): r.spend for r in files.read_mart(spark, path).collect()}
    doubled = df.withColumn("spend", (F.col("spend") * 2).cast("decimal(18,4)"))
    marts.build(doubled, str(tmp_path), months=[200003])
    after = {(r.segment, r.year_month): r.spend for r in files.read_mart(spark, path).collect()}
    assert set(before) == set(after)
    for key, value in after.items():
        assert value == before[key] * (2 if key[1] == 200003 else 1)


def test_report_writes_every_metric(spark, folder, tmp_path):
    explore.write(fact(spark, folder), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(
        ["spend_stats", "segment_spend", "category_spend", "entity_spend", "monthly_trend", "state_spend",
         "pareto", "category_concentration", "ecommerce_impact"])
    shares = files.read_report(spark, os.path.join(tmp_path, "category_concentration"))
    assert abs(shares.agg(F.sum("pct")).first()[0] - 100) < 1e-9


def test_raw_csv_types_and_bad_cells(spark, tmp_path):
    from spendlake.schema import RAW_COLUMNS
    cells = {"Year Month": "2025-03", "Customer Market Segment Id": "S", "Spend Random Factor": "12.50"}
    good = [cells.get(c, "") for c in RAW_COLUMNS]
    bad = [{**cells, "Spend Random Factor": "n/a", "Number of Rooms": "x"}.get(c, "") for c in RAW_COLUMNS]
    (tmp_path / "raw.csv").write_text("\n".join(",".join(r) for r in (RAW_COLUMNS, good, bad)) + "\n")
    rows = files.raw_to_fact(files.read_raw_csv(spark, str(tmp_path / "raw.csv"))).collect()
    assert [(r.year_month, float(r.spend) if r.spend is not None else None, r.rooms) for r in rows] == [
        (202503, 12.5, None), (202503, None, None)]


def test_fact_joins_only_what_it_needs(spark, folder):
    plan = star.spend_fact(spark, folder, "cat_l1", "spend")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "o_orderdate" not in plan


def test_fixed_dimensions(spark, tmp_path):
    from spendlake.operators import events as ev
    from spendlake.sources import dims
    sizes = {name: dims.read_dimension(spark, name).count() for name in dims.SCHEMAS}
    assert sizes == {"state_reference": 52, "event_calendar": 137, "event_uplift": 70, "segment_labels": 28}
    scores = ev.event_scores(dims.read_dimension(spark, "event_calendar"))
    assert scores.agg(F.min("event_score")).first()[0] > 0
    assert dims.read_dimension(spark, "event_uplift").groupBy("state", "year_month").count().filter("count > 1").count() == 0
    own = tmp_path / "labels.csv"
    own.write_text("# mine\nsegment,label\nX,Ex\n")
    assert dims.read_dimension(spark, "segment_labels", str(own)).collect() == [("X", "Ex")]


def test_no_spend_is_lost_to_a_missing_key(spark):
    from decimal import Decimal

    from spendlake.operators import rollup
    from spendlake.schema import DETAIL_KEYS
    whole = {"segment": "S", "client_id": "1", "customer_id": "11", "state": "AL", "cat_l1": "C", "year_month": 202501}
    lines = [whole] + [{**whole, key: None} for key in DETAIL_KEYS]
    df = spark.createDataFrame([tuple(r[k] for k in DETAIL_KEYS) + (Decimal(10),) * 3 for r in lines],
                               "segment string, client_id string, customer_id string, state string, cat_l1 string, "
                               "year_month int, spend decimal(18,4), list_price decimal(18,4), savings decimal(18,4)")
    detail = rollup.customer_month(df)
    total = lambda frame: float(frame.agg(F.sum("spend")).first()[0])
    assert total(detail) == 70.0
    assert total(marts.portfolio_month(detail)) == 60.0  # all but the line without a month
    for frame in (marts.segment_month, marts.category_month, marts.state_month):
        assert total(frame(detail)) == 50.0  # nor the line without the key
    assert marts.client_concentration(detail).where("client_id IS NULL").count() == 0


def test_a_customer_counts_once(spark):
    df = spark.createDataFrame([("c1", "S", "Active", 1.0), ("c1", "S", "INACTIVE", 1.0), ("c2", "S", "INACTIVE", 1.0)],
                               "customer_id string, segment string, ecomm_status string, spend double")
    from spendlake.operators import rollup
    row = rollup.ecomm_penetration(marts.customer_summary(df)).first()
    assert (row.ecomm_active, row.total_locations, row.ecomm_penetration) == (1, 2, 0.5)


def test_customer_profile_shuffles_once(spark):
    """Two distinct counts over one grouping: no copy of a line for each of them, and one shuffle of the lines."""
    rows = [("a", "x", "1", 3.0, "1.5"), ("a", "x", "2", 3.0, None), ("a", "y", "2", None, "2.5"), ("a", "x", "1", 3.0, "1.5"),
            ("b", None, "1", None, None), (None, "z", "9", 1.0, "7")]
    lines = spark.createDataFrame(rows, "customer_id string, cat_l1 string, distributor_id string, rooms double, spend string")
    got = rollup.customer_profile(lines.withColumn("spend", F.col("spend").cast("decimal(18,4)")))
    found = {r.customer_id: (r.total_spend and float(r.total_spend), r.avg_spend and round(float(r.avg_spend), 4), *r[3:]) for r in got.collect()}
    assert found == {"a": (5.5, 1.8333, 3, 2, 2, 1), "b": (None, None, 0, 0, 1, 0)}
    assert dict(got.dtypes)["total_spend"] == "decimal(38,4)" and dict(got.dtypes)["avg_spend"] == "decimal(38,6)"
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan
    executed = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert executed.count("Exchange hashpartitioning") == 1


def test_customer_profile_over_joins_by_key(spark, tmp_path):
    """Joined by key, lines reach the grouping by order: spend is one number by then, and the parts are joined before."""
    from spendlake.catalog.base import customer_profiles
    lines = [(o, p, s, 1, 100.0, 0.25) for o, p, s in [(1, 1, 10), (1, 2, 10), (2, 3, 11), (2, 9, None), (3, 1, 10), (9, 1, 12), (None, 1, 10)]]
    lines += [(3, 2, 13, 2, None, 0.5), (3, None, 14, 3, 50.0, None)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double"),
        "orders": ([(1, 6), (2, 6), (3, 7), (4, 8)], "o_orderkey long, o_custkey long"),
        "part": ([(1, "A"), (2, "B"), (3, "A"), (3, None)], "p_partkey long, p_type string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = customer_profiles(spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {r.customer_id: (float(r.total_spend), r.transactions, r.unique_categories, r.unique_distributors, r.has_rooms)
                 for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The part with two rows makes its line two; lines without an order have no customer.
    assert found == {"6": (375.0, 5, 2, 2, 0), "7": (75.0, 1, 2, 3, 1)}
    at = [plan.index(f"Exchange hashpartitioning({key}#") for key in ("customer_id", "l_orderkey", "l_partkey")]
    assert at == sorted(at)  # from the last shuffle to the first
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert "l_orderkey" in joins[0] and "l_partkey" in joins[1]
    above = plan[:plan.rindex("Exchange hashpartitioning(l_partkey")]
    assert "l_discount" not in above and "l_extendedprice" not in above


def test_emptied_months_go(spark, tmp_path):
    path = str(tmp_path / "mart")
    build = lambda part: part.groupBy("year_month").agg(F.sum("spend").alias("spend"))
    frame = lambda rows: spark.createDataFrame(rows, "year_month int, spend double")
    months = lambda: {r.year_month: r.spend for r in files.read_mart(spark, path).collect()}
    files.write_mart(build(frame([(202501, 1.0), (202502, 2.0), (202503, 3.0)])), path)
    files.refresh_mart(frame([(202501, 5.0), (202503, 9.0)]), build, path, [202501, 202502])
    assert months() == {202501: 5.0, 202503: 3.0}
    files.write_mart(build(frame([(202503, 4.0)])), path)
    assert months() == {202503: 4.0}


def test_raw_csv_to_marts(spark, tmp_path):
    from spendlake.schema import RAW_COLUMNS
    lines = [",".join(RAW_COLUMNS)]
    for i in range(40):
        cells = {"Year Month": f"2025-{i % 12 + 1:02d}", "Customer Market Segment Id": f"S{i % 2}", "Client ID": str(i % 5),
                 "Customer Id": str(i % 10), "State": "AL", "Category Level 1": "C", "Ecommerce Status": "ACTIVE",
                 "Spend Random Factor": "12.50"}
        lines.append(",".join(cells.get(c, "") for c in RAW_COLUMNS))
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    df = files.raw_to_fact(files.read_raw_csv(spark, str(tmp_path / "raw.csv")))
    assert df.where("row_id IS NULL").count() == 0
    folder = str(tmp_path / "marts")
    marts.build(df, folder)
    assert float(files.read_mart(spark, os.path.join(folder, "segment_month")).agg(F.sum("spend")).first()[0]) == 500.0
    assert files.read_mart(spark, os.path.join(folder, "segment_features")).count() == 2


def test_functions_run_on_workers_from_any_folder():
    """The package travels by value: a worker that can't import it still runs its functions."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    from spendlake.models.anomaly import _average_path
    code = f"import pickle; print(pickle.loads({cloudpickle.dumps(_average_path)!r})(2))"
    assert pickle.loads(cloudpickle.dumps(_average_path))(2) == 1.0
    said = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert said.stdout.strip() == "1.0", said.stderr


def test_lines_move_twice_for_all_columns(spark, folder):
    """Once for the parts and once for the orders, which bring their customers; each join moved all lines before."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = star.spend_fact(spark, folder, "segment", "cat_l1", "cat_l2", "year_month", "rooms", "spend")._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line.split("Join")[1] for line in plan.toString().split("\n") if "Join " in line]
    assert len(joins) == 3 and sum("l_" in j for j in joins) == 2 and "o_orderdate" not in plan.toString().split("Relation")[0]
