"""Mixing of sources to target weights by weighted sampling in passes.

Every document gets an exponential key, -ln(u) / weight, with u from a hash of its doc_id (Efraimidis and
Spirakis). A source whose target is e times its size and a rest is taken whole e times, and then document by document in the
order of the keys until the words taken reach the rest; the document at the edge is taken if that comes
nearer to the target.

No source is sorted as a whole. Keys are cut into buckets; sums by (source, bucket) tell the bucket in which
the rest is reached, and only that bucket is sorted. All other rows compare their bucket with it.

Defined results: NULL text has size 0; NULL source is a source of its own and comes last; a NULL, NaN or non-positive
weight counts as the smallest valid one (1 if there is none); rows without doc_id share one key, unless a key of rows is given. Equal keys
go by doc_id, then size, then the key of rows. Sources without words have target 0 and are taken 0 times. Repeated rows are documents of
their own. Very long texts are counted whole; an empty table gives no rows; other columns of any name go along unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercantile.llm.tables import free_name, scratch
from mercantile.llm.textkit import BLANK_SEPARATED, find_words, slices

MOST_EPOCHS = 3
_ROWS_PER_BUCKET, _MOST_BUCKETS = 2_000, 100_000


def word_counts(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of every row, and the number of words of its text as ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [find_words(data, at, BLANK_SEPARATED).counts for _, _, data, at in slices(batch.column(0))]
            if sizes:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(sizes), pa.int64())], [*columns, "size"])

    chosen = docs.select(F.col("text").cast("string").alias("text"), *columns)
    return chosen.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[1:]) + ", size long")


def uniform(doc_id: Column) -> Column:
    """A number strictly between 0 and 1 that depends on nothing but ``doc_id``: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, rest) from (source, source_size): one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "place")
    weight = (1 + (F.col("place") - 1) % 3).alias("weight")
    placed = sizes.select("*", F.row_number().over(by_name).alias("place")).select("*", weight)
    placed = placed.select("*", (MOST_EPOCHS * F.col("source_size") / F.col("weight")).alias("room"), F.sum("source_size").over(Window.partitionBy()).alias("total"))
    before = F.coalesce(F.sum("source_size").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("total") - MOST_EPOCHS * before) / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    levels = placed.select("*", level.alias("level")).select("*", F.min(F.when(F.col("room") >= F.col("level"), F.struct("room", "place", "level"))).over(Window.partitionBy()).alias("last"))
    most, share = F.col("source_size") * float(MOST_EPOCHS), F.col("last.level") * F.col("weight")
    shared = levels.select("source", "source_size", F.when(most <= share, most).otherwise(share).alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(MOST_EPOCHS).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0).cast("long"))
    return shared.select("*", epochs.alias("epochs")).select("*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def mix(rows: DataFrame, *carried: str, row: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) from rows of (doc_id, source, size, weight); ``carried``
    columns of the rows, under other names than the plan's, follow.

    ``row``, a column that follows too, tells rows apart: then the keys come from it instead of the doc_id, and it breaks ties. Rows that share
    it must be equal, so that any of them may stand for another.
    """
    carried = tuple(dict.fromkeys([*carried, *([row] if row else [])]))
    store = scratch(rows.sparkSession)
    valid = F.when((F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")), F.col("weight"))
    rows = store.store(rows.select("doc_id", "source", "size", valid.alias("weight"), *carried), "sizes")
    facts = rows.agg(F.count("*").alias("n"), F.min("weight").alias("least")).first()
    least, n_buckets = facts["least"] or 1.0, int(np.clip(facts["n"] // _ROWS_PER_BUCKET, 1, _MOST_BUCKETS))
    key = -F.log(uniform(F.col(row or "doc_id"))) / F.coalesce("weight", F.lit(least))
    keyed = rows.select("doc_id", "source", "size", key.alias("key"), *carried)
    # The exponential of a scaled key is spread over 0..1, most densely w / least times as dense as evenly.
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") * least)) * n_buckets), F.lit(n_buckets - 1).cast("long"))
    keyed = keyed.select("*", bucket.alias("bucket"))

    sums = store.store(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    plan = store.store(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))), "targets")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    running = sums.select("source", "bucket", "words", before.alias("before")).withColumnRenamed("source", "own")
    edge = running.join(plan, F.col("own").eqNullSafe(F.col("source"))).where("before < rest AND before + words >= rest")
    edge = edge.groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("edge")).withColumnRenamed("source", "own")
    plan = store.store(plan.join(edge, F.col("own").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "epochs", "rest", "edge.*"), "plan")
    plan = plan.withColumnsRenamed({"source": "of", "bucket": "edge_bucket", "before": "edge_before"})

    met = keyed.join(plan, F.col("of").eqNullSafe(F.col("source")))
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs", *carried]
    outside = met.where("edge_bucket IS NULL OR bucket <> edge_bucket").select(*columns, (F.col("edge_bucket").isNotNull() & (F.col("bucket") < F.col("edge_bucket"))).alias("more"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", *([row] if row else []))
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("edge_before")
    inside = met.where("bucket = edge_bucket").select(*columns, "rest", upto.alias("upto"))
    inside = inside.select(*columns, ((F.col("upto") < F.col("rest")) & (2 * (F.col("rest") - F.col("upto")) >= F.col("size"))).alias("more"))
    copies = F.col("epochs") + F.col("more").cast("long")
    return outside.unionByName(inside).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carried)


def _scored_sizes(score: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, at in slices(batch.column(0)):
                sizes.append(find_words(data, at, BLANK_SEPARATED).counts)
                weights.append(score(data, at))
            columns = [*batch.columns[1:], pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(weights), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "row", "size", "weight"])

    return run


def _known_rows(docs: DataFrame) -> Column:
    """A 128-bit hash of all columns, NULLs told from empty values."""
    parts = [F.coalesce(F.concat(F.lit("="), docs[f"`{c}`"].cast("string")), F.lit("")) for c in docs.columns]
    lengths = [F.length(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("\x1f", *lengths, *parts))


def row_sizes(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, source, row, size, weight) of every row: its key, its words, and the ``score`` of its text as weight.

    ``score`` takes the bytes of several texts and their offsets.
    """
    chosen = docs.select(
        docs["text"].cast("string").alias("text"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), _known_rows(docs).alias("row")
    )
    return chosen.mapInArrow(_scored_sizes(score), "doc_id long, source string, row string, size long, weight double")


def repeat_mixed(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Every row of ``docs``, all columns, as often as the mix takes it, whatever the layout of ``docs``.

    Rows are told apart by all their columns. Equal rows are one row with the sum of their copies, folded in tasks before they are
    shuffled, so a row that many others equal meets them as one.
    """
    copies = mix(row_sizes(docs, score), row="row")
    own, times = free_name(docs.columns, "mix_row"), free_name(docs.columns, "mix_times")
    totals = copies.groupBy(F.col("row").alias(own)).agg(F.sum("copies").alias(times)).where(F.col(times) > 0)
    distinct = docs.withColumn(own, _known_rows(docs)).dropDuplicates([own])
    met = distinct.join(totals, own)
    return met.select(*[met[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[f"`{c}`" for c in docs.columns])


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, size, weight): a labelled good document weighs 1, a bad one a quarter, others a half."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("quality").alias("quality"))
    sizes = word_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), "doc_id", "source")
    weight = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.25).otherwise(0.5)
    return sizes.join(known, F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "source", "size", weight.alias("weight"))


MIX_SQL = """
WITH known AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
keyed AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
           / CASE k.quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS key
  FROM documents d LEFT JOIN known k ON k.doc_id = d.doc_id),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sizes),
weighed AS (SELECT *, 1 + (place - 1) % 3 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM placed),
roomy AS (SELECT *, 3 * source_size / weight AS room FROM weighed),
levels AS (
  SELECT *, CAST(total - 3 * coalesce(sum(source_size) OVER (ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
           / CAST(sum(weight) OVER (ORDER BY room, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM roomy),
final AS (SELECT *, (SELECT l.level FROM levels l WHERE l.room >= l.level ORDER BY l.room, l.place LIMIT 1) AS last FROM levels),
planned AS (
  SELECT source, source_size, CASE WHEN source_size * 3.0::DOUBLE <= last * weight THEN source_size * 3.0::DOUBLE ELSE last * weight END AS target FROM final),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM planned),
ordered AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - k.size AS upto
  FROM keyed k JOIN passes p ON p.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN upto < rest AND 2 * (rest - upto) >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""
