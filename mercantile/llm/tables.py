"""Tables of a folder, and folders for what a job stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercantile.sources.scratch import Scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> Scratch:
    """Stored copies in the shared folder that the cluster names, one run folder per call."""
    return Scratch(spark)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or one like it that none of the columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
