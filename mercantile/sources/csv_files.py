"""CSV files by column name, in parallel also where values hold line breaks, with the rows that can't be read.

Spark splits a CSV file only if no value has a line break. Here files are read as lines, which split anywhere, and records are put
together from them:

1. A first pass counts the quotes of each split. A line break is within a value exactly if an odd number of quotes stands before
   it in the file, so the sums of the splits before it tell each split whether it begins within a value.
2. In a second pass every task walks its splits' lines: a line that ends outside of quotes ends a record. What stands before a split's
   first such end belongs to the record that an earlier split began, so each split gives at most two fragments.
3. Fragments are joined by the split in which their record begins: a few rows a split.

Columns are taken by the names of each file's first line. What can't be read as its declared type is NULL in the table and
listed, with its record and columns, among the rejects; a record with too few or too many values is listed only.

Quotes are doubled within quoted values, and have no other use. A split, here, is what Spark reads as one piece of a file
(``spark.sql.files.maxPartitionBytes``); what is broadcast has one entry per split and per file.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_ROWS = pa.schema([("file", pa.string()), ("split", pa.int64()), ("head", pa.int32()), ("kind", pa.int32()), ("record", pa.string())])
_SCHEMA = "file string, split long, head int, kind int, record string"
#: Whole records, and begins and continuations of records that reach over the edge of a split.
_WHOLE, _BEGIN, _MORE = 0, 1, 2
_PROBLEM_WIDTH, _PROBLEM_VALUE = "number of values", "bad value"


@dataclass
class CsvLoad:
    """``table``: the declared columns. ``rejects``: (file, record, problem, columns). Both read the files when they are used."""

    table: DataFrame
    rejects: DataFrame

    def counts(self) -> DataFrame:
        """(problem, column_name, records): records with a bad value in a column, or with a wrong number of values (no column)."""
        none = F.array(F.lit(None).cast("string"))
        named = self.rejects.select("problem", F.explode(F.when(F.size("columns") > 0, F.col("columns")).otherwise(none)).alias("column_name"))
        return named.groupBy("problem", "column_name").agg(F.count("*").alias("records"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files with their file and the begin of their split; a task has the lines of a split in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


class _Walk:
    """Puts records together from a task's lines. ``opens``: splits that begin within a value; ``heads``: each file's kind of header."""

    def __init__(self, opens: set[tuple[str, int]], heads: dict[str, int]):
        self.opens, self.heads = opens, heads
        self.at: tuple[str, int] | None = None
        self.held: list[str] = []
        self.inside = self.more = self.header = False

    def _row(self, kind: int) -> pa.RecordBatch:
        values = (*self.at, self.heads[self.at[0]], kind, "\n".join(self.held))
        self.held = []
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ROWS, strict=True)], schema=_ROWS)

    def _rows(self, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        columns = [pa.repeat(pa.scalar(v, f.type), n) for v, f in zip((*self.at, self.heads[self.at[0]], _WHOLE), _ROWS, strict=False)]
        return pa.RecordBatch.from_arrays([*columns, records], schema=_ROWS)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The open record at the end of a split."""
        if self.held and not self.header:
            yield self._row(_MORE if self.more else _BEGIN)
        self.held = []

    def lines(self, at: tuple[str, int], lines: pa.Array, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lines of one split, in order; ``odd``: whether a line has an odd number of quotes."""
        if at != self.at:
            yield from self.close()
            self.at, self.header = at, at[1] == 0
            self.inside = self.more = at in self.opens
        after = (np.cumsum(odd) + self.inside) % 2 == 1
        self.inside = bool(after[-1])
        ends, start = np.flatnonzero(~after), 0
        if len(ends) and (self.held or self.more or self.header):
            start = int(ends[0]) + 1
            self.held += lines[:start].to_pylist()
            if self.header:
                self.held = []
            else:
                yield self._row(_MORE if self.more else _WHOLE)
            self.more = self.header = False
            ends = ends[1:]
        if len(ends):
            begins = np.r_[start, ends[:-1] + 1]
            single = begins == ends
            if single.any():
                yield self._rows(lines.take(pa.array(ends[single])))
            for begin, end in zip(begins[~single].tolist(), ends[~single].tolist(), strict=True):
                self.held = lines[begin : end + 1].to_pylist()
                yield self._row(_WHOLE)
            start = int(ends[-1]) + 1
        self.held += lines[start:].to_pylist()


def _walked(opens: set[tuple[str, int]], heads: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(opens, heads)
        for batch in batches:
            if not batch.num_rows:
                continue
            file, split, line = batch.columns
            places = split.to_numpy()
            other = np.ones(len(places), dtype=bool)
            other[1:] = (places[1:] != places[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            odd = pc.count_substring(line, '"').to_numpy(zero_copy_only=False) % 2 == 1
            bounds = np.r_[np.flatnonzero(other), len(places)].tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield from walk.lines((file[a].as_py(), int(places[a])), line[a:b], odd[a:b])
        yield from walk.close()

    return run


def _records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(file, head, record) of all records but the header lines, and the distinct header lines by their number ``head``."""
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    numbered = lines.select("file", "split", "value", quotes.alias("quotes"), F.monotonically_increasing_id().alias("id"))
    facts = numbered.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"), F.min_by(F.when(F.col("split") == 0, F.col("value")), "id").alias("head"))
    opens, first, before, file = set(), {}, 0, None
    for r in facts.orderBy("file", "split").collect():  # one row per split
        if r["file"] != file:
            file, before, first[r["file"]] = r["file"], 0, r["head"]
        if before % 2:
            opens.add((r["file"], r["split"]))
        before += r["quotes"]
    distinct = sorted(set(first.values()))
    number = {head: k for k, head in enumerate(distinct)}

    found = lines.mapInArrow(_walked(opens, {f: number[h] for f, h in first.items()}), _SCHEMA)
    whole = found.where(F.col("kind") == _WHOLE).select("file", "head", "record")
    # A record that reaches over edges is of the split with its begin; there are at most two such rows of a split.
    order = Window.partitionBy("file").orderBy("split", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    parts = found.where(F.col("kind") != _WHOLE)
    parts = parts.select("*", F.max(F.when(F.col("kind") == _BEGIN, F.col("split"))).over(order).alias("begun")).where("begun IS NOT NULL")
    texts = F.sort_array(F.collect_list(F.struct("split", "record"))).getField("record")
    crossing = parts.groupBy("file", "head", "begun").agg(F.array_join(texts, "\n").alias("record")).select("file", "head", "record")
    return whole.unionByName(crossing), distinct


def _names(head: str) -> list[str]:
    names = next(csv.reader([head.lstrip("\ufeff").rstrip("\r")]))
    return [n.strip() for n in names]


def _parsed(records: DataFrame, names: list[str], schema: StructType) -> DataFrame:
    """(file, record, wide, bad, and the declared columns) of records under one header."""
    places = {n: k for k, n in reversed(list(enumerate(names)))}  # of a name that stands twice the first column counts
    fields = StructType([StructField(f"c{k}", StringType()) for k in range(len(names))] + [StructField("_wrong", StringType())])
    options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_wrong", "maxCharsPerColumn": "-1", "multiLine": "true", "mode": "PERMISSIVE", "maxColumns": str(max(20_480, len(names) + 1))}
    parsed = records.select("file", "record", F.from_csv("record", fields.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("p"))
    values = {f.name: (F.col(f"p.c{places[f.name]}") if f.name in places else F.lit(None).cast("string")) for f in schema}
    cast = {f.name: values[f.name].try_cast(f.dataType) for f in schema}
    bad = F.filter(F.array(*[F.when(values[n].isNotNull() & cast[n].isNull(), F.lit(n)) for n in cast]), lambda n: n.isNotNull())
    return parsed.select("file", "record", F.col("p._wrong").isNotNull().alias("wide"), bad.alias("bad"), *[c.alias(n) for n, c in cast.items()])


def load_csv(spark: SparkSession, path: str, schema: StructType) -> CsvLoad:
    """A file or a folder of files with headers. Columns of ``schema`` that a file lacks are NULL; others are left out.

    Empty values are NULL, quoted or not; empty lines are no records.
    """
    records, heads = _records(spark, path)
    records = records.select("file", "head", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
    rows = None
    for number, head in enumerate(heads):
        own = _parsed(records if len(heads) == 1 else records.where(F.col("head") == number), _names(head), schema)
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        none = spark.createDataFrame([], schema)
        return CsvLoad(none, spark.createDataFrame([], "file string, record string, problem string, columns array<string>"))
    problem = F.when(F.col("wide"), F.lit(_PROBLEM_WIDTH)).otherwise(F.lit(_PROBLEM_VALUE))
    columns = F.when(F.col("wide"), F.array().cast("array<string>")).otherwise(F.col("bad"))
    rejects = rows.where("wide OR size(bad) > 0").select("file", "record", problem.alias("problem"), columns.alias("columns"))
    return CsvLoad(rows.where("NOT wide").select(*schema.names), rejects)
