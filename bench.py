"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed runs after one warm-up;
the median counts. Building the plan is part of the time, as are the intermediate tables some queries write.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parcelwise.session import remove_written  # noqa: E402
from workload.queries import registered  # noqa: E402

HEADLINE = """
    enriched_orders customer_order_sequence fct_orders dim_customers
    mart_delivery_promise mart_first_orders mart_monthly mart_seller_delivery
    scope_summary monthly_promise delay_vs_promise bad_review_timing handover_summary
    seller_excess seller_concentration route_table calibrate_routes evaluate_policy margin_grid
    rolling_quantile_by_state evaluate_rolling_policy repeat_summary state_standardised_repeat
    pitfall_counts derived_figures expectation_report metrics_table
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registered()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE

    def once(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        remove_written(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
