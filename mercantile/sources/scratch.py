"""Intermediate tables in the cluster's shared folder.

A mart that several later steps read is written once and read back, so a lost executor costs a
re-read and never a recomputation of the whole plan behind it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one below the warehouse, which all executors reach too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context_dir = spark.sparkContext.getCheckpointDir()
    if context_dir:
        return context_dir.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"


class Scratch:
    """Writes frames below one run folder and hands back frames that read them."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.folder = f"{root or shared_root(spark)}/mercantile-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a frame that scans the written files."""
        target = self.path(name)
        df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def release(self) -> None:
        """Delete this run's folder. Frames that read stored tables are of no use afterwards."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(hadoop).delete(folder, True)
