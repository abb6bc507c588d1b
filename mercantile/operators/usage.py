"""Metering of calls against a monthly limit per key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercantile.functions import dimensions as dim
from mercantile.functions.dates import month_of
from mercantile.functions.expressions import lookup, row_count

def tier_limit(tier: str | Column, limits: Mapping[str, int | None] = dim.TIER_CALLS) -> Column:
    """Calls per month of a tier; NULL means unlimited."""
    return lookup(tier, {k: v for k, v in limits.items() if v is not None}).cast("long")


def monthly_usage(calls: DataFrame, limits: Mapping[str, int | None] = dim.TIER_CALLS) -> DataFrame:
    """Calls, accepted and rejected calls per key and month.

    A call is accepted while fewer accepted calls than the limit came before it, so the number
    accepted is the smaller of the two. This needs a count only, which folds map-side.
    """
    counted = calls.groupBy("api_key", "tier", month_of("ts").alias("month")).agg(row_count().alias("calls"))
    return with_accepted(counted, limits)


def with_accepted(counted: DataFrame, limits: Mapping[str, int | None] = dim.TIER_CALLS) -> DataFrame:
    accepted = F.least("calls", F.coalesce(tier_limit("tier", limits), F.col("calls")))
    return counted.withColumn("accepted", accepted).withColumn("rejected", F.col("calls") - F.col("accepted"))


def flag_calls(
    calls: DataFrame, limits: Mapping[str, int | None] = dim.TIER_CALLS, shards: int | None = None
) -> DataFrame:
    """Every call with whether it was accepted, in order of time and then call id.

    Ranking all calls of a busy key would put that key in one task. Only its first ``limit`` calls
    matter: each shard of the key keeps its own first ``limit``, and the call at rank ``limit``
    among those survivors is the last one accepted, so at most shards x limit rows of a key meet in
    one place. The calls then look up that boundary; adaptive execution splits the partition of a
    busy key in this join, because nothing after it needs the key's rows together.
    """
    shards = shards or int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("ts"), F.col("call_id")]
    dated = calls.select(
        "call_id", "api_key", "ts", month_of("ts").alias("month"), tier_limit("tier", limits).alias("cap")
    )
    in_shard = Window.partitionBy("api_key", "month", "shard").orderBy(*order)
    overall = Window.partitionBy("api_key", "month").orderBy(*order)
    # A key within its limit has no boundary, and neither has one without a limit.
    boundary = (
        dated.where("cap IS NOT NULL")
        .withColumn("shard", F.pmod(F.xxhash64("call_id"), F.lit(shards)))
        .withColumn("n", F.row_number().over(in_shard))
        .where("n <= cap")
        .withColumn("n", F.row_number().over(overall))
        .where("n = cap")
        .select("api_key", "month", F.struct("ts", "call_id").alias("last_accepted"))
    )
    accepted = F.coalesce(F.struct("ts", "call_id") <= F.col("last_accepted"), F.lit(True))
    if any(cap == 0 for cap in limits.values()):
        accepted = accepted & ((F.col("cap") > 0) | F.col("cap").isNull())
    return dated.join(boundary, ["api_key", "month"], "left").select(
        "call_id", "api_key", "month", accepted.alias("accepted")
    )
