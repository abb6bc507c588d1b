"""Exported marts: load whichever exist, and write them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercantile.sources.catalog import MartCatalog
from mercantile.sources.schemas import MART_FILES, MART_TABLES


# Other names under which the same columns occur in exported files. Fixed values.
COLUMN_ALIASES = {"customer_id": "customer_unique_id", "recency": "recency_days"}


def read_mart(spark: SparkSession, directory: str, name: str, form: str = "csv") -> DataFrame:
    """One mart with its declared columns and types.

    Columns are matched by name, so files may order them differently, lack some or add others.
    """
    schema, folder = MART_TABLES[name], directory.rstrip("/")
    if form == "parquet":
        raw = spark.read.parquet(f"{folder}/{name}")
    else:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(f"{folder}/{MART_FILES[name]}")
    present = {c.strip().lstrip("\ufeff"): c for c in raw.columns}
    for other, name_ in COLUMN_ALIASES.items():
        if other in present:
            present.setdefault(name_, present[other])
    return raw.select(
        *[
            (F.col(f"`{present[f.name]}`") if f.name in present else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load_marts(
    spark: SparkSession, directory: str, names: Iterable[str] | None = None, form: str = "csv"
) -> tuple[dict[str, DataFrame], list[str]]:
    """All marts found in ``directory`` and the names of those that are missing.

    A published mart (see ``catalog``) is read by its manifest, others from the file or folder of their name. Only what is not
    there is missing: a mart that is there and can't be read raises.
    """
    catalog, folder = MartCatalog(spark, directory), directory.rstrip("/")
    published = set(catalog.names())
    found, missing = {}, []
    for name in names or MART_TABLES:
        if form == "parquet" and name in published:
            found[name] = catalog.read(name)
        elif _exists(spark, f"{folder}/{name if form == 'parquet' else MART_FILES[name]}"):
            found[name] = read_mart(spark, directory, name, form)
        else:
            missing.append(name)
    return found, missing


def write_mart(df: DataFrame, path: str, form: str = "parquet", partition_by: Iterable[str] = ()) -> None:
    """Write a mart as Parquet (default) or as CSV with a header. The folder holds one file per task."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown form: {form}")


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a mart as a table bucketed and sorted by ``key``, so that joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
