"""CSV files by name: records over split edges, reordered headers, bad values, files of several kinds."""

import csv
import random
from datetime import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType, TimestampNTZType

from mercantile.plans import registry
from mercantile.sources import retail
from mercantile.sources.csv_files import load_csv

SCHEMA = StructType([StructField("id", LongType()), StructField("amount", DecimalType(18, 2)), StructField("note", StringType()), StructField("at", TimestampNTZType())])


@pytest.fixture()
def small_splits(spark):
    """Splits of a few hundred bytes, so that nearly every record with a line break may lie on an edge."""
    names = {"spark.sql.files.maxPartitionBytes": "257", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def write(path, header, data):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(header)
        out.writerows(data)


def notes(n, seed=1):
    pick = random.Random(seed)
    parts = ["plain", 'a "quoted" word', "line\nbreak", "\n\n", "comma, here", "é日", '"', "", "x" * 90, "many\nlines\n" * 40]
    return [(k, f"{k}.50", "".join(pick.choice(parts) for _ in range(pick.randint(0, 3))), "2018-01-05 10:00:01") for k in range(n)]


def test_quoted_line_breaks_across_edges(spark, tmp_path, small_splits):
    data = notes(300)
    write(tmp_path / "a.csv", ["id", "amount", "note", "at"], data)
    load = load_csv(spark, str(tmp_path / "a.csv"), SCHEMA)
    assert load.table.rdd.getNumPartitions() > 50
    want = [(k, Decimal(a), n or None, dt(2018, 1, 5, 10, 0, 1)) for k, a, n, _ in data]
    assert sorted(map(tuple, load.table.collect())) == sorted(want)
    assert load.rejects.count() == 0 and load.counts().count() == 0


def test_a_value_longer_than_many_splits(spark, tmp_path, small_splits):
    long = "line\n" * 2000
    write(tmp_path / "a.csv", ["note", "id"], [("first", 1), (long, 2), ("last", 3)])
    load = load_csv(spark, str(tmp_path), SCHEMA)
    assert {r["id"]: r["note"] for r in load.table.collect()} == {1: "first", 2: long, 3: "last"}


def test_headers_in_any_order(spark, tmp_path, small_splits):
    data = notes(40)
    write(tmp_path / "a.csv", ["id", "amount", "note", "at"], data[:10])
    write(tmp_path / "b.csv", ["at", "more", "note", "id", "amount"], [(t, "more", n, k, a) for k, a, n, t in data[10:30]])
    write(tmp_path / "c.csv", ["note", "id"], [(n, k) for k, _, n, _ in data[30:]])
    (tmp_path / "d.csv").write_bytes("﻿id,amount\r\n77,1.25\r\n\r\n78,\r\n".encode())
    got = load_csv(spark, str(tmp_path), SCHEMA).table.collect()
    want = [(k, Decimal(a) if k < 30 else None, n or None, dt(2018, 1, 5, 10, 0, 1) if k < 30 else None) for k, a, n, _ in data]
    want += [(77, Decimal("1.25"), None, None), (78, None, None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bad_values_are_counted(spark, tmp_path):
    write(tmp_path / "a.csv", ["id", "amount", "note", "at"], [(1, "x", "fine", "yesterday"), ("one", "2.5", "", ""), (3, "1", "ok", "2018-01-05 10:00:01"), (4, "5")])
    with open(tmp_path / "a.csv", "a") as f:
        f.write("5,6,7,2018-01-05,9\n")
    load = load_csv(spark, str(tmp_path), SCHEMA)
    assert rows(load.table, "id", "amount", "note") == [(1, None, "fine"), (3, Decimal("1.00"), "ok"), (None, Decimal("2.50"), None)]
    assert rows(load.counts()) == [("bad value", "amount", 1), ("bad value", "at", 1), ("bad value", "id", 1), ("number of values", None, 2)]
    assert {(r["record"], r["problem"], tuple(r["columns"])) for r in load.rejects.collect()} == {
        ("1,x,fine,yesterday", "bad value", ("amount", "at")),
        ("one,2.5,,", "bad value", ("id",)),
        ("4,5", "number of values", ()),
        ("5,6,7,2018-01-05,9", "number of values", ()),
    }


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert load_csv(spark, str(tmp_path), SCHEMA).table.count() == 0
    (tmp_path / "b.csv").write_text("id,amount\n")
    load = load_csv(spark, str(tmp_path), SCHEMA)
    assert load.table.count() == 0 and load.rejects.count() == 0 and load.table.columns == SCHEMA.names


def test_reviews_load_in_many_tasks_by_name(spark, tmp_path, small_splits):
    header = ["review_comment_message", "review_score", "order_id", "review_id", "review_creation_date"]
    data = [(f"good\n\"value\" {k}\n", "9" if k == 4 else "five" if k == 7 else k % 5 + 1, f"o{k}", f"r{k}", "2018-01-05 00:00:00") for k in range(200)]
    write(tmp_path / retail.RAW_FILES["reviews"], header, data)
    tables = retail.read_raw_csv(spark, str(tmp_path), {"reviews": retail.RAW_FILES["reviews"]})
    got = {r["review_id"]: r for r in tables.reviews.collect()}
    assert len(got) == 200 and got["r3"]["review_score"] == 4 and got["r7"]["review_score"] is None
    assert tables.reviews.rdd.getNumPartitions() > 1
    assert rows(tables.loads["reviews"].counts()) == [("bad value", "review_score", 1)]


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "nullif(text, '') AS text", "lang", "source", "n_chars")
    assert rows(registry.all_queries()["csv_documents"](spark, folder)) == rows(want)
