"""Streaming forms of the jobs that are useful while data keeps arriving.

Each takes and returns frames; ``run_to_parquet`` and ``run_to_table`` start them. The batch
functions supply all column logic.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mercantile.functions import dimensions as dim
from mercantile.functions.dates import month_of
from mercantile.operators.cleaning import orders_clean
from mercantile.operators.scoring import rejected_requests, score_requests
from mercantile.operators.usage import with_accepted


def parquet_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of the Parquet files at ``path``, which is a folder or one file."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # The file source accepts a single file only through a pattern; this one matches the path itself.
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_parquet(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available, appending results to a folder; a restart continues where it stopped."""
    query = (
        frame.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_table(frame: DataFrame, checkpoint: str, prefix: str) -> str:
    """Process everything available into an in-memory table, for results of a few rows only."""
    name = f"{prefix}_{uuid.uuid4().hex[:8]}"
    query = (
        frame.writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return name


def score_stream(requests: DataFrame, *carried: str) -> DataFrame:
    """Scores requests as they arrive. Stateless, and the same expression as in batch."""
    return score_requests(requests, *carried)


def reject_stream(requests: DataFrame, *carried: str) -> DataFrame:
    """Requests that fail a check as they arrive, with the failing fields: what ``score_stream`` leaves out."""
    return rejected_requests(requests).select(*carried, "failed_fields")


def daily_usage_stream(calls: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Calls per key and day, emitted once a day is closed by the watermark.

    Counts fold map-side before they reach the state, so a busy key adds one row per task.
    """
    return (
        calls.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("api_key", "tier", F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .select("api_key", "tier", F.to_date("w.start").alias("day"), "calls")
    )


def monthly_usage_of_days(days: DataFrame, limits: Mapping[str, int | None] = dim.TIER_CALLS) -> DataFrame:
    """Closed days rolled up to months, with accepted and rejected calls."""
    counted = days.groupBy("api_key", "tier", month_of("day").alias("month")).agg(F.sum("calls").alias("calls"))
    return with_accepted(counted, limits)


def monthly_revenue_stream(payments: DataFrame, orders: DataFrame, copies: int = 1) -> DataFrame:
    """Revenue per purchase month of arriving payments, against a stored table of orders.

    The state and the result hold one row per month. A stream cannot fold payments per order before
    the join, so where single orders receive very many payments, ``copies`` spreads each order's
    payments over that many tasks at the cost of as many copies of the order keys.
    """
    placed = orders_clean(orders).select("order_id", month_of("order_purchase_timestamp").alias("month"))
    keys = ["order_id"]
    if copies > 1:
        keys.append("part")
        placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        payments = payments.withColumn(
            "part", F.pmod(F.xxhash64("payment_sequential", "payment_value"), F.lit(copies)).cast("int")
        )
    return payments.join(placed, keys).groupBy("month").agg(F.sum("payment_value").alias("revenue"))
