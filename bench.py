"""Headline queries, timed on ``local[$BENCH_CPUS]``. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendlake.catalog import ENTRIES  # noqa: E402
from spendlake.session import build_session  # noqa: E402

HEADLINE = [
    "A00_customer_month", "A01_portfolio_month", "A02_segment_month", "A05_two_levels", "A07_ecomm_impact",
    "A09_summary", "A12_customer_profile", "A20_state_category_pivot", "A28_gini", "A32_category_entropy",
    "W01_cascading_lags", "W03_pareto", "W05_event_score", "W11_row_number", "P12_strategic_class",
    "Q01_trend_features", "Q02_factor_correlation", "Q08_mutual_information", "Q09_basket_similarity",
    "G01_year_over_year", "G06_event_spend_detail", "M01_stratified_sample", "M03_feature_matrix",
    "M04_event_features", "M07_random_forest", "M23_corridor", "M25_segment_state_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    ENTRIES["A08_monthly_total"].run(spark, folder).collect()  # start the executors and the compiler
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
