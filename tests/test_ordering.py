"""Tiles, quantiles, splits and running totals against plain windows and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mercantile.ml import split
from mercantile.operators.ordering import add_tiles, quantile_values, running_totals


def table(spark, n, seed=1):
    pick = random.Random(seed)
    # A third of the rows share one value of each measure.
    data = [
        (i, 1 if i % 3 == 0 else pick.randint(1, 40), round(0.5 if i % 3 == 1 else pick.uniform(0, 500), 2))
        for i in pick.sample(range(10 * n + 1), n)
    ]
    return spark.createDataFrame(data, "id long, orders int, spent double")


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 1003])
def test_tiles_equal_ntile(spark, scratch, n):
    df = scratch.store(table(spark, n), "rows")
    keys = {"f": F.col("orders"), "r": -F.col("orders"), "m": F.col("spent")}
    got = add_tiles(df, keys, "id", 5, scratch)
    for name, key in keys.items():
        want = df.withColumn("want", F.ntile(5).over(Window.orderBy(key, "id")))
        assert got.join(want.select("id", "want"), "id").where(F.col(name) != F.col("want")).count() == 0
    assert got.count() == n


def test_tiles_with_all_keys_tied_and_text_ids(spark, scratch):
    df = scratch.store(spark.range(11).select(F.format_string("c%02d", "id").alias("id"), F.lit(1).alias("k")), "tied")
    got = {r["id"]: r["t"] for r in add_tiles(df, {"t": F.col("k")}, "id", 5, scratch).collect()}
    assert [got[f"c{i:02d}"] for i in range(11)] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


@pytest.mark.parametrize("n", [1, 2, 10, 777])
def test_quantiles_equal_numpy(spark, scratch, n):
    df = scratch.store(table(spark, n, seed=n), "rows")
    wanted = {f"{c}_{p}": (c, p) for c in ("orders", "spent") for p in (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)}
    got = quantile_values(df, wanted, scratch)
    pdf = df.toPandas()
    for name, (column, p) in wanted.items():
        assert got[name] == pytest.approx(np.quantile(pdf[column], p), abs=1e-9)


def test_quantile_leaves_out_nulls_and_handles_none(spark, scratch):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert quantile_values(df, {"a": ("a", 0.5), "b": ("b", 0.5)}, scratch) == {"a": 2.0, "b": None}


def test_results_do_not_depend_on_the_number_of_partitions(spark, scratch):
    df = scratch.store(table(spark, 500), "rows")
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            tiles = add_tiles(df, {"m": F.col("spent")}, "id", 5, scratch)
            found.append((sorted(map(tuple, tiles.collect())), quantile_values(df, {"q": ("spent", 0.9)}, scratch)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[0] == found[1]


def test_running_totals_equal_a_window(spark, scratch):
    df = table(spark, 600).groupBy("spent").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(df, "spent", ["n"], scratch)
    want = df.withColumn("want", F.sum("n").over(Window.orderBy("spent")))
    assert got.join(want.select("spent", "want"), "spent").where("n_upto <> want").count() == 0
    assert {r["n_all"] for r in got.select("n_all").collect()} == {600}


@pytest.mark.parametrize("n,train", [(1, 0), (4, 3), (10, 8), (101, 80)])
def test_split_by_recency_is_positional(spark, scratch, n, train):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 7).cast("int").alias("recency_days"))
    got = split.by_recency(df, "id", scratch).collect()
    want = sorted((r["recency_days"], r["id"]) for r in got)
    assert sorted((r["recency_days"], r["id"]) for r in got if r["split"] == "train") == want[:train]


def test_stratified_split_keeps_class_shares(spark, scratch):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("churn_label"))
    counts = split.stratified(df, "id", "churn_label", scratch).groupBy("churn_label", "split").count().collect()
    assert sorted(map(tuple, counts)) == [(0, "test", 180), (0, "train", 720), (1, "test", 20), (1, "train", 80)]
