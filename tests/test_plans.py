"""What the plans must keep to at scale, read off the plans themselves (no broadcast by size)."""

import re

import pytest

from mercantile.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.001"

# Their windows without partition run over the final aggregate: segments, categories or states.
SMALL_AGGREGATES = ["segment_distribution", "category_revenue_rank", "top_categories", "top_states"]


@pytest.fixture(scope="module")
def plan_of(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda name: all_queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


CHECKED = [
    "orders_clean", "order_revenue", "one_time_buyer_pct", "customer_cohorts", "cohort_retention", "monthly_revenue",
    "customer_rfm", "segment_distribution", "high_value_customers", "category_revenue_rank", "top_categories", "top_states",
    "churn_features", "customer_detail", "usage_metering", "usage_call_flags", "split_by_recency", "eval_ranking",
]


def test_the_window_check_sees_a_one_task_window(spark, plan_of):
    lines = plan_of("segment_distribution").splitlines()
    assert any("Exchange SinglePartition" in line for line in lines) and any("Window [" in line for line in lines)


@pytest.mark.parametrize("name", CHECKED)
def test_no_table_goes_through_one_task(plan_of, name):
    plan = plan_of(name)
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan and "MapInPandas" not in plan
    lines = plan.splitlines()
    windows = [i for i, line in enumerate(lines) if re.match(r"\W*(\*\(\d+\) )?Window \[", line)]
    below = ["".join(lines[i + 1 : i + 4]) for i in windows]
    if name not in SMALL_AGGREGATES:
        assert not any("Exchange SinglePartition" in b for b in below)


@pytest.mark.parametrize(
    "name,columns",
    [
        ("order_revenue", {"l_orderkey", "l_extendedprice"}),
        ("customer_cohorts", {"l_orderkey", "l_shipdate"}),
        ("monthly_revenue", {"l_orderkey", "l_shipdate", "l_extendedprice"}),
        ("one_time_buyer_pct", {"l_orderkey", "l_shipdate"}),
        ("category_revenue_rank", {"l_partkey", "l_extendedprice"}),
    ],
)
def test_scans_read_only_what_is_used(plan_of, name, columns):
    plan = plan_of(name)
    scans = re.findall(r"lineitem\.parquet.*?ReadSchema: struct<([^>]*)>", plan)
    read = {c.split(":")[0] for scan in scans for c in scan.split(",")}
    assert scans and read == columns


def test_line_items_are_scanned_once_for_the_customer_mart(plan_of):
    assert len(re.findall(r"lineitem\.parquet", plan_of("one_time_buyer_pct"))) == 1


def test_a_threshold_reaches_the_scan(plan_of):
    assert "monetary" in re.search(r"DataFilters: \[([^\]]*)\]", plan_of("high_value_customers")).group(1)
