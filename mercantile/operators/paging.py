"""Pages of a table in key order, without sorting what stands before them.

The rows are stored in ranges of the key, a folder each. A sparse index holds each range's first and last key and its number of rows: one
entry per range. A page by offset, or behind a key, opens the ranges that hold it and no other, two at most unless the
page is longer than a range.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from mercantile.sources.scratch import Scratch


@dataclass(frozen=True)
class Range:
    slot: int
    first: Any
    last: Any
    rows: int


class PageIndex:
    """A stored table and its index; ``key`` must be unique and not NULL."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        index = spark.read.parquet(f"{path}/index").orderBy("slot").collect()
        self.ranges = [Range(r["slot"], r["first"], r["last"], r["rows"]) for r in index]

    @classmethod
    def build(cls, df: DataFrame, key: str, scratch: Scratch, ranges: int | None = None) -> PageIndex:
        """Store ``df`` in ranges of the key, as many as there are shuffle partitions unless told otherwise."""
        spark, path = df.sparkSession, scratch.path("pages")
        ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        laid = df.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("slot", F.spark_partition_id())
        laid.write.partitionBy("slot").parquet(f"{path}/rows")
        schema = StructType([*df.schema.fields])
        stored = spark.read.schema(laid.schema).parquet(f"{path}/rows")
        facts = stored.groupBy("slot").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))
        facts.coalesce(1).write.parquet(f"{path}/index")
        return cls(spark, path, schema, key)

    @property
    def rows(self) -> int:
        return sum(r.rows for r in self.ranges)

    def _of(self, ranges: list[Range]) -> DataFrame:
        """The rows of some ranges; the condition on their folders keeps all others unread."""
        stored = self.spark.read.schema(StructType([*self.schema.fields, StructField("slot", IntegerType())])).parquet(f"{self.path}/rows")
        return stored.where(F.col("slot").isin([r.slot for r in ranges])).select(*self.schema.names)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``limit`` rows from place ``offset`` on, in key order."""
        before, chosen, skip = 0, [], 0
        for r in self.ranges:
            if before + r.rows > offset and before < offset + limit:
                if not chosen:
                    skip = offset - before
                chosen.append(r)
            before += r.rows
        return self._of(chosen).orderBy(self.key).offset(skip).limit(limit if chosen else 0)

    def after(self, last: Any, limit: int) -> DataFrame:
        """``limit`` rows behind a key, which need not be in the table; the next page is after the last key of this one."""
        chosen, sure = [], 0
        for r in self.ranges:
            if r.last > last and sure < limit:
                chosen.append(r)
                sure += r.rows if r.first > last else 0  # of the range that the key falls in none are sure
        return self._of(chosen).where(F.col(self.key) > F.lit(last)).orderBy(self.key).limit(limit if chosen else 0)
