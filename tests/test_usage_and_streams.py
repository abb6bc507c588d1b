import random
from datetime import datetime as dt
from datetime import timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mercantile.operators import usage
from mercantile.plans import registry
from mercantile.streaming import jobs

LIMITS = {"starter": 3, "growth": 40, "enterprise": None}
SCHEMA = "call_id long, api_key string, tier string, ts timestamp_ntz"


def calls(n=900, seed=3):
    pick = random.Random(seed)
    keys = [("hot", "growth"), ("free", "starter"), ("big", "enterprise"), ("calm", "growth")]
    out = []
    for i in range(n):
        # The first key makes a third of all calls, many at the same moment.
        key, tier = keys[0] if i % 3 == 0 else pick.choice(keys[1:])
        when = dt(2024, 1, 1) + timedelta(hours=pick.randint(0, 24 * 50) // 12 * 12)
        out.append((i, key, tier, when))
    return out


def accepted_by_hand(data):
    used, flags = {}, {}
    for i, key, tier, when in sorted(data, key=lambda c: (c[3], c[0])):
        month, cap = (key, when.month), LIMITS[tier]
        ok = cap is None or used.get(month, 0) < cap
        used[month] = used.get(month, 0) + ok
        flags[i] = ok
    return flags


@pytest.mark.parametrize("shards", [1, 8])
def test_flags_equal_a_counter(spark, shards):
    data = calls()
    got = usage.flag_calls(spark.createDataFrame(data, SCHEMA), LIMITS, shards)
    assert {r["call_id"]: r["accepted"] for r in got.collect()} == accepted_by_hand(data)


def test_counts_equal_flags(spark):
    frame = spark.createDataFrame(calls(), SCHEMA)
    per_call = usage.flag_calls(frame, LIMITS).groupBy("api_key", "month").agg(F.count_if("accepted").alias("n"))
    assert rows(per_call) == rows(usage.monthly_usage(frame, LIMITS), "api_key", "month", "accepted")


def test_a_limit_of_zero_accepts_nothing(spark):
    frame = spark.createDataFrame(calls(30), SCHEMA)
    none = {"starter": 0, "growth": 0, "enterprise": 0}
    assert usage.flag_calls(frame, none).where("accepted").count() == 0
    assert usage.monthly_usage(frame, none).agg(F.sum("accepted")).first()[0] == 0


def test_closed_days_equal_the_batch(spark, scratch):
    data = calls(300)
    source, sink = scratch.path("calls"), scratch.path("days")
    frame = spark.createDataFrame(data, SCHEMA)
    frame.coalesce(1).write.parquet(source)
    stream = jobs.parquet_stream(spark, source, frame.schema)
    days = jobs.daily_usage_stream(stream, "0 seconds")
    jobs.run_to_parquet(days, sink, scratch.path("state"))
    got = jobs.monthly_usage_of_days(spark.read.schema(days.schema).parquet(sink), LIMITS)
    last = max(c[3] for c in data).replace(hour=0)
    want = usage.monthly_usage(frame.where(F.col("ts") < F.lit(last)), LIMITS)
    assert rows(got, "api_key", "month", "calls", "accepted") == rows(want, "api_key", "month", "calls", "accepted")


def test_a_call_behind_the_watermark_is_dropped(spark, scratch):
    source, sink, state = scratch.path("calls"), scratch.path("days"), scratch.path("state")

    def arrive(*days):
        data = [(i, "k", "growth", dt(2024, 1, d, 6)) for i, d in enumerate(days)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.parquet_stream(spark, source, frame_schema, files_per_batch=1)
        jobs.run_to_parquet(jobs.daily_usage_stream(stream, "1 day"), sink, state)

    frame_schema = spark.createDataFrame([], SCHEMA).schema
    arrive(1, 2)
    arrive(5)
    arrive(1, 4)  # day 1 is closed by now, day 4 is not
    arrive(9)
    got = spark.read.parquet(sink).orderBy("day").collect()
    assert [(r["day"].day, r["calls"]) for r in got] == [(1, 1), (2, 1), (4, 1), (5, 1)]


def test_registered_streams_equal_their_batch_queries(spark):
    queries, folder = registry.all_queries(), "/root/testdata/sf0.001"
    for stream, batch in (("stream_score", "score_customers"), ("stream_monthly_revenue", "monthly_revenue")):
        assert rows(queries[stream](spark, folder)) == rows(queries[batch](spark, folder))


def test_spread_payments_give_the_same_revenue(spark, scratch):
    from shop import shop

    tables = shop(spark)
    path = scratch.path("payments")
    tables.payments.write.parquet(path)
    found = []
    for copies in (1, 4):
        stream = jobs.parquet_stream(spark, path, tables.payments.schema)
        totals = jobs.monthly_revenue_stream(stream, tables.orders, copies)
        found.append(rows(spark.table(jobs.run_to_table(totals, scratch.path("state"), "spread"))))
    assert found[0] == found[1] and len(found[0]) == 4
