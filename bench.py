"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder of the test tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default: all)

Every query starts from the raw tables: nothing built for one is reused by the next. One untimed
query warms the session up first.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from mercantile.plans.registry import all_queries

HEADLINES = [
    "orders_clean",
    "order_revenue",
    "dq_orphans",
    "customer_retention_base",
    "churn_summary",
    "customer_rfm",
    "segment_distribution",
    "rfm_score_stats",
    "high_value_customers",
    "cohort_retention",
    "cohort_retention_by_churn",
    "monthly_revenue",
    "revenue_trends",
    "revenue_forecast_by_state",
    "seasonality",
    "category_revenue_rank",
    "top_categories",
    "top_sellers",
    "top_states",
    "churn_features",
    "score_customers",
    "customer_list",
    "campaign_plan",
    "retention_scenarios",
    "report_kpis",
    "executive_summary",
    "usage_metering",
    "usage_call_flags",
    "csv_documents",
    "customer_page_deep",
    "top_categories_layout",
    "ml_folds",
    "stream_call_flags",
    "ml_standardize",
    "eval_ranking",
    "ml_churn_train",
    "stream_monthly_revenue",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # A folder of its own, so that no model of an earlier run is found.
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        # Call-site capture costs a millisecond or more for every column operation.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    run("customer_retention_base")
    seconds = {name: run(name) for name in HEADLINES}
    line = {
        "metric": "total_wall_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cores": int(cores),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
