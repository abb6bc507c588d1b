"""Streams that keep their results by batch: late files, restarts, batches that run twice, busy keys."""

import random
from datetime import datetime as dt
from datetime import timedelta
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F
from shop import shop

from mercantile.operators import revenue, usage
from mercantile.plans import registry
from mercantile.sources.retail import RetailTables
from mercantile.streaming import jobs
from mercantile.streaming.ledger import BatchLedger
from mercantile.streaming.metering import CallMeter
from mercantile.streaming.revenue import RevenueLedger

LIMITS = {"starter": 3, "growth": 40, "enterprise": None}
CALLS = "call_id long, api_key string, tier string, ts timestamp_ntz"


def calls(n, seed):
    pick = random.Random(seed)
    keys = [("hot", "growth"), ("free", "starter"), ("big", "enterprise"), ("calm", "growth")]
    out = []
    for i in range(n):
        key, tier = keys[0] if i % 3 == 0 else pick.choice(keys[1:])
        out.append((1000 * seed + i, key, tier, dt(2024, 1, 1) + timedelta(hours=pick.randint(0, 24 * 50) // 12 * 12)))
    return out


def land(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def flags(frame):
    return rows(frame, "call_id", "api_key", "month", "accepted")


@pytest.mark.parametrize("shards", [1, 5])
def test_flags_equal_the_batch_after_late_files_and_a_restart(spark, scratch, shards):
    landing, folder = scratch.path("calls"), scratch.path("meter")
    data = []
    for part in range(4):
        # Every file has calls of the whole time, so many come after later ones.
        new = calls(150, part)
        data += new
        land(spark, landing, new, CALLS)
        stream = jobs.parquet_stream(spark, landing, spark.createDataFrame([], CALLS).schema, files_per_batch=1)
        # A new meter each time: all it knows is in its folder.
        meter = CallMeter(spark, folder, LIMITS, shards=shards)
        meter.run(stream)
        want = usage.flag_calls(spark.createDataFrame(data, CALLS), LIMITS)
        assert flags(meter.flags()) == flags(want)
    assert meter.revoked.read().count() > 10
    # Only what a batch can start from is kept.
    state = spark.read.parquet(f"{folder}/state")
    assert state.select("month", "batch").distinct().groupBy("month").count().agg(F.max("count")).first()[0] <= 2


def test_a_batch_that_runs_twice_changes_nothing(spark, scratch):
    parts = [spark.createDataFrame(calls(200, k), CALLS) for k in range(3)]
    meter = CallMeter(spark, scratch.path("meter"), LIMITS)
    for number, part in enumerate(parts):
        meter.take(part, number)
        meter.take(part, number)
    want = usage.flag_calls(parts[0].unionByName(parts[1]).unionByName(parts[2]), LIMITS)
    assert flags(meter.flags()) == flags(want)


def test_an_early_call_pushes_out_the_last(spark, scratch):
    meter = CallMeter(spark, scratch.path("meter"), {"starter": 2})
    made = [(k, "k", "starter", dt(2024, 1, 5 + k)) for k in range(3)]
    meter.take(spark.createDataFrame(made, CALLS), 0)
    assert [r["accepted"] for r in meter.flags().orderBy("call_id").collect()] == [True, True, False]
    meter.take(spark.createDataFrame([(9, "k", "starter", dt(2024, 1, 1)), (10, "k", "starter", dt(2024, 2, 1))], CALLS), 1)
    assert {r["call_id"]: r["accepted"] for r in meter.flags().collect()} == {0: True, 1: False, 2: False, 9: True, 10: True}
    assert [r["call_id"] for r in meter.revoked.read().collect()] == [1]


def test_limits_of_zero_and_none(spark, scratch):
    meter = CallMeter(spark, scratch.path("meter"), {"starter": 0, "growth": 0, "enterprise": None})
    meter.take(spark.createDataFrame(calls(60, 1), CALLS), 0)
    got = meter.flags().groupBy(F.col("api_key") == "big", "accepted").count().collect()
    assert {(r[0], r[1]) for r in got} == {(True, True), (False, False)}


def test_empty_batches(spark, scratch):
    meter = CallMeter(spark, scratch.path("meter"), LIMITS)
    assert meter.flags().count() == 0
    meter.take(spark.createDataFrame([], CALLS), 0)
    assert meter.flags().count() == 0


def test_a_busy_key_is_folded_in_many_tasks(spark, scratch):
    """No window over a whole key: the first one is within shards, the second sees at most shards x limit calls."""
    made = [(k, "hot", "starter", dt(2024, 1, 1) + timedelta(seconds=k % 977)) for k in range(4000)]
    meter = CallMeter(spark, scratch.path("meter"), {"starter": 5}, shards=8)
    meter.take(spark.createDataFrame(made, CALLS).repartition(6), 0)
    want = usage.flag_calls(spark.createDataFrame(made, CALLS), {"starter": 5})
    assert flags(meter.flags()) == flags(want)
    assert spark.read.parquet(f"{meter.folder}/state").count() == 5


PAID = "order_id string, payment_sequential int, payment_value decimal(18,2)"


def paid(n, seed):
    pick = random.Random(seed)
    return [(pick.choice(["o1", "o1", "o1", "o2", "o3", "o7", "gone"]), k, Decimal(pick.randint(1, 9999)) / 100) for k in range(n)]


def batch_revenue(spark, tables, data):
    payments = spark.createDataFrame([(o, k, "boleto", 1, v) for o, k, v in data], "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value decimal(18,2)")
    facts = RetailTables(orders=tables.orders, payments=payments, reviews=tables.reviews).order_facts(reviews=False)
    return [r for r in rows(revenue.period_revenue(facts, "month"))if r[1]]


def test_revenue_equals_the_batch_after_a_restart_and_with_a_hot_order(spark, scratch):
    tables, landing, folder, data = shop(spark), scratch.path("payments"), scratch.path("revenue"), []
    for part in range(5):
        new = paid(120, part)
        data += new
        land(spark, landing, new, PAID)
        ledger = RevenueLedger(spark, folder, tables.orders, fold_after=2)
        ledger.run(jobs.parquet_stream(spark, landing, spark.createDataFrame([], PAID).schema, files_per_batch=1))
        assert [(str(m), v) for m, v in rows(ledger.monthly())] == [(str(m), v) for m, v in batch_revenue(spark, tables, data)]
    # Older batches are folded into one folder.
    assert len(ledger.deltas.batches()) < 5


def test_a_replayed_batch_counts_once(spark, scratch):
    tables = shop(spark)
    ledger = RevenueLedger(spark, scratch.path("revenue"), tables.orders, fold_after=2)
    parts = [paid(50, k) for k in range(4)]
    for number, part in enumerate(parts):
        for _ in range(2):
            ledger.take(spark.createDataFrame(part, PAID), number)
    got = [(str(m), v) for m, v in rows(ledger.monthly())]
    assert got == [(str(m), v) for m, v in batch_revenue(spark, tables, sum(parts, []))]


def test_half_written_batches_are_invisible(spark, scratch):
    frame = spark.range(3).selectExpr("id", "id * 2 AS v")
    ledger = BatchLedger(spark, scratch.path("ledger"), frame.schema)
    assert ledger.read().count() == 0
    ledger.write(0, frame)
    frame.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{ledger.folder}/batch=1")
    assert ledger.batches() == [0] and ledger.read().count() == 3
    ledger.write(1, frame)
    ledger.compact(2, lambda df: df.groupBy("id").agg(F.sum("v").alias("v")), least=2)
    assert ledger.batches() == [] and rows(ledger.read()) == [(0, 0), (1, 4), (2, 8)]


def test_registered_streams(spark):
    queries, folder = registry.all_queries(), "/root/testdata/sf0.001"
    assert rows(queries["stream_call_flags"](spark, folder)) == rows(queries["usage_call_flags"](spark, folder))
