"""Accepting or rejecting calls as they arrive.

A call is accepted while fewer than the limit of its key and month come before it, in order of time and call id. Files may come late, so
a call that was accepted can be pushed out by an earlier one that arrives after it; one that was rejected stays so. The state of
a key and month are its first ``limit`` calls so far: these are the accepted ones. Each micro-batch

1. keeps, per shard of a key, the batch's first ``limit`` calls, so a busy key is folded in many tasks,
2. merges them with the state of the months that the batch touches: at most (shards + 1) x limit calls of a key meet,
3. flags the batch's calls by the last accepted call of their key, and writes a revocation for each call of the old state
   that is no longer among the first.

Flags, revocations and state are folders by batch number (see ``ledger``). A batch that runs again starts from the state before
it, so it writes the same.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mercantile.functions import dimensions as dim
from mercantile.functions.dates import month_of
from mercantile.operators.usage import tier_limit
from mercantile.streaming.ledger import BatchLedger, run_batches

_FLAGS = "call_id long, api_key {key}, month date, accepted boolean"
_REVOKED = "call_id long, api_key {key}, month date"
_STATE = "api_key {key}, ts timestamp_ntz, call_id long, cap long, month date, batch long"


class CallMeter:
    """The meter of one stream of calls (call_id, api_key, tier, ts), with all it keeps below ``folder``."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        limits: Mapping[str, int | None] = dim.TIER_CALLS,
        key_type: str = "string",
        shards: int | None = None,
    ):
        self.spark, self.folder, self.limits = spark, folder.rstrip("/"), limits
        self.shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.schemas = {n: StructType.fromDDL(s.format(key=key_type)) for n, s in {"flags": _FLAGS, "revoked": _REVOKED, "state": _STATE}.items()}
        self.flagged = BatchLedger(spark, f"{self.folder}/flags", self.schemas["flags"])
        self.revoked = BatchLedger(spark, f"{self.folder}/revoked", self.schemas["revoked"])

    def run(self, calls: DataFrame) -> None:
        """Take in everything that has arrived since the last run."""
        run_batches(calls, self.take, f"{self.folder}/checkpoint")

    def _state_before(self, batch: int, months: list) -> DataFrame:
        """The newest state before the batch, of the given months. Each month's state is rewritten only by batches that touch it."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        paths = []
        for month in months:
            own = self.spark._jvm.org.apache.hadoop.fs.Path(top, f"month={month}")
            if files.exists(own):
                numbers = [int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(own)]
                paths += [f"{own.toString()}/batch={max(n for n in numbers if n < batch)}" for _ in [0] if any(n < batch for n in numbers)]
        if not paths:
            return self.spark.createDataFrame([], self.schemas["state"])
        return self.spark.read.schema(self.schemas["state"]).option("basePath", top.toString()).parquet(*paths)

    def take(self, calls: DataFrame, batch: int) -> None:
        """One micro-batch."""
        order = [F.col("ts"), F.col("call_id")]
        dated = calls.select("call_id", "api_key", "ts", month_of("ts").alias("month"), tier_limit("tier", self.limits).alias("cap"))
        # Read twice below: once for the candidates, once for the flags.
        dated = dated.persist()
        try:
            months = sorted(r["month"] for r in dated.where("cap IS NOT NULL").select("month").distinct().collect())
            old = self._state_before(batch, months).select("api_key", "ts", "call_id", "cap", "month")
            in_shard = Window.partitionBy("api_key", "month", "shard").orderBy(*order)
            overall = Window.partitionBy("api_key", "month").orderBy(*order)
            new = (
                dated.where("cap IS NOT NULL")
                .withColumn("shard", F.pmod(F.xxhash64("call_id"), F.lit(self.shards)))
                .withColumn("n", F.row_number().over(in_shard))
                .where("n <= cap")
                .select("api_key", "ts", "call_id", "cap", "month")
            )
            merged = new.unionByName(old).withColumn("n", F.row_number().over(overall))
            first = merged.where("n <= cap").select("api_key", "ts", "call_id", "cap", "month", F.lit(batch).cast("long").alias("batch"))
            writer = first.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch")
            writer.parquet(f"{self.folder}/state")

            kept = self._state_before(batch + 1, months)
            full = kept.groupBy("api_key", "month").agg(F.max(F.struct("ts", "call_id")).alias("last"), F.count("*").alias("held"), F.max("cap").alias("limit"))
            # A key below its limit has no boundary yet.
            full = full.where("held >= limit").select("api_key", "month", "last")
            place = F.struct("ts", "call_id")
            pushed = old.join(full, ["api_key", "month"]).where(place > F.col("last"))
            self.revoked.write(batch, pushed)
            accepted = (F.col("cap").isNull() | (F.col("cap") > 0)) & F.coalesce(place <= F.col("last"), F.lit(True))
            flags = dated.join(full, ["api_key", "month"], "left").select("call_id", "api_key", "month", accepted.alias("accepted"))
            self.flagged.write(batch, flags)
        finally:
            dated.unpersist()
        self._forget(batch, months)

    def _forget(self, batch: int, months: list) -> None:
        """Delete states that no batch can start from any more: all but the two newest of each touched month."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for month in months:
            own = self.spark._jvm.org.apache.hadoop.fs.Path(top, f"month={month}")
            if files.exists(own):
                numbers = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in files.listStatus(own))
                for number in [n for n in numbers if n <= batch][:-2]:
                    files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(own, f"batch={number}"), True)

    def flags(self) -> DataFrame:
        """(call_id, api_key, month, accepted) of every call taken in so far, revocations applied.

        Revocations are few: only calls that were accepted before an earlier one arrived.
        """
        gone = self.revoked.read().select("call_id", "api_key", "month").distinct().withColumn("gone", F.lit(True))
        held = self.flagged.read().join(gone, ["call_id", "api_key", "month"], "left")
        return held.select("call_id", "api_key", "month", (F.col("accepted") & F.col("gone").isNull()).alias("accepted"))
