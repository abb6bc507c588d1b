"""Benchmark passages in documents, found by winnowing.

Words are hashed, then every run of ``GRAM`` words. Of the grams in a window of ``window`` words the one of smallest hash (the first of equal
ones) is kept as a fingerprint, with its place. Two equal windows keep the same gram at the same place within them, so documents and items that
share a span of ``window`` words or more always share a fingerprint there. An item of fewer words is one window of its own size.

1. The fingerprints of the benchmark become a membership bitmap of fixed maximal size, which is broadcast.
2. One pass over the documents keeps their fingerprints that may be in the benchmark, with the hashes of the words around
   each: as many as a window that holds the gram can reach.
3. Fingerprints of documents and items are joined. Each hit is extended word by word in both directions; if the words that
   agree are a window or more, they are hit. Items with the same words around a fingerprint are one side of the join.
4. A document's hits are merged into spans.

If the benchmark outgrows the bitmap, more fingerprints pass step 2 and the join drops them; nothing is lost.

Defined results: NULL or wordless texts have no words, no hits and no items; a wordless item hits nothing; an item
without item_id still marks words but is not listed. Repeated rows of a document are judged each by its own text. Very long texts are
judged whole, in time linear in their words and hits. An empty table on either side gives no hits. Columns other than doc_id and text may
have any name and are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercantile.llm import sketch
from mercantile.llm.tables import free_name, scratch
from mercantile.llm.textkit import LETTERS_AND_DIGITS, Words, find_words, hash_runs, hash_spans, lowered, mix, run_starts, signed, slices

WINDOW = 10
GRAM = 5


def _words(data: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray]:
    data = lowered(data)
    words = find_words(data, at, LETTERS_AND_DIGITS)
    return words, hash_spans(data, words.start, words.end)


def _fingerprints(hashes: np.ndarray, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, mark) of the grams that the windows of ``size`` words at ``starts`` keep."""
    gram = min(GRAM, size)
    grams = hash_runs(hashes, gram, 3)
    if not len(starts):
        return starts, grams[:0]
    least, place = grams[starts], np.zeros(len(starts), dtype=np.int64)
    for shift in range(1, size - gram + 1):
        part = grams[starts + shift]
        less = part < least
        least, place[less] = np.where(less, part, least), shift
    kept = np.unique(starts + place)
    return kept, mix(grams[kept], size)


def _around(words: Words, hashes: np.ndarray, size: int, place: np.ndarray, nothing: int) -> np.ndarray:
    """The hashes of the words that windows with the gram at ``place`` can hold; ``nothing`` beyond the text's ends."""
    gram = min(GRAM, size)
    spot = place[:, None] + np.arange(gram - size, size)
    text = words.text[place]
    inside = (spot >= words.first[text][:, None]) & (spot < words.first[text + 1][:, None])
    return np.where(inside, hashes[np.clip(spot, 0, len(hashes) - 1)], np.uint64(nothing))


def benchmark_fingerprints(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, mark, size, around, c1, c2) of every fingerprint of every item; c1 and c2 are hashes of the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, end, data, at in slices(batch.column(1)):
                words, hashes = _words(data, at)
                counts = words.counts
                for size in range(1, window + 1):
                    starts = run_starts(words, size)
                    if size < window:
                        starts = starts[counts[words.text[starts]] == size]
                    place, mark = _fingerprints(hashes, size, starts)
                    if not len(place):
                        continue
                    around = _around(words, hashes, size, place, 1)
                    own = ids.take(pa.array(words.text[place] + first))
                    c1, c2 = (mix(mix(around, salt) + np.arange(around.shape[1], dtype=np.uint64) * mix(np.array([salt], np.uint64))).sum(axis=1) for salt in (81, 82))
                    columns = [own, pa.array(signed(mark)), pa.array(np.full(len(place), size, np.int32)), pa.array([a.tobytes() for a in around], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(signed(mix(c1, size))), pa.array(signed(mix(c2, size)))], ["item_id", "mark", "size", "around", "c1", "c2"])

    chosen = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "item_id long, mark long, size int, around binary, c1 long, c2 long")


def _candidates(marks, sizes: list[int]):
    kind = pa.struct([("mark", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("near", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                words, hashes = _words(data, at)
                found: list[tuple] = []
                for size in sizes:
                    place, mark = _fingerprints(hashes, size, run_starts(words, size))
                    kept = marks.value.test(mix(mark))
                    place, mark = place[kept], mark[kept]
                    near = [a.tobytes() for a in _around(words, hashes, size, place, 0)] if len(place) else []
                    text = words.text[place] if len(place) else place
                    found += zip(text.tolist(), signed(mark).tolist(), [size] * len(place), (place - words.first[text]).tolist() if len(place) else [], near, strict=True)
                found.sort(key=lambda f: f[0])
                bounds = np.searchsorted([f[0] for f in found], np.arange(end - first + 1))
                item = pa.array([dict(zip(("mark", "size", "place", "near"), f[1:], strict=True)) for f in found], kind)
                columns = [
                    batch.column(0).slice(first, end - first).cast(pa.int64()),
                    batch.column(2).slice(first, end - first),
                    pa.array(words.counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), item),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ref", "n_words", "places"])

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ref, size, place, near, around, c1, c2): the words that agree around a shared gram, if they are a window or more."""
    for batch in batches:
        sizes, places = (batch.column(k).to_numpy() for k in (1, 2))
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            gram, reach = min(GRAM, size), size - min(GRAM, size)
            near, around = (np.frombuffer(b"".join(batch.column(k).take(pa.array(own)).to_pylist()), dtype=np.uint64).reshape(len(own), -1) for k in (3, 4))
            equal = near == around
            left = np.cumprod(equal[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(equal[:, reach + gram :], axis=1).sum(axis=1)
            hit = equal[:, reach : reach + gram].all(axis=1) & (left + gram + right >= size)
            a, b = (places[own] - left)[hit], (places[own] + gram + right)[hit]
            rows = batch.take(pa.array(own[hit]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(a, pa.int32()), pa.array(b, pa.int32()), rows.column(5), rows.column(6)], ["ref", "a", "b", "c1", "c2"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ref, hits) to (ref, spans): hits that overlap or touch are one span."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        hits, out = batch.column(1), []
        bounds = np.r_[0, np.cumsum(hits.value_lengths().to_numpy())]
        flat = hits.flatten()
        first, last = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        for k in range(len(hits)):
            a, b = first[bounds[k] : bounds[k + 1]], last[bounds[k] : bounds[k + 1]]
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.r_[True, a[1:] > b[:-1]]
            ends = np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]
            out.append([{"a": x, "b": y} for x, y in zip(a[new].tolist(), b[ends].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["ref", "spans"])


def _ref(docs: DataFrame) -> Column:
    """A 128-bit hash of doc_id and text, by which a document's hits come back to it."""
    parts = [F.coalesce(F.concat(F.lit("="), docs[c].cast(kind).cast("string")), F.lit("")) for c, kind in (("doc_id", "long"), ("text", "string"))]
    return F.md5(F.concat(parts[0], F.lit("|"), parts[1]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans, ref.

    ``spans`` are the maximal runs of hit words, as (first word, word after the last); ``ref`` is a hash of doc_id and text.
    """
    spark = docs.sparkSession
    store = scratch(spark)
    shared = store.store(benchmark_fingerprints(benchmark, window), "fingerprints")
    sizes = sorted(r["size"] for r in shared.select("size").distinct().collect())
    marks = sketch.members(shared.select("mark").distinct(), "mark", sketch.bits_for(16 * shared.count()))

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _ref(docs).alias("ref"))
    schema = "doc_id long, ref string, n_words long, places array<struct<mark: long, size: int, place: int, near: binary>>"
    rows = store.store(chosen.mapInArrow(_candidates(spark.sparkContext.broadcast(marks), sizes), schema), "candidates")

    # Items with the same words around a fingerprint are one side of the join, however many they are.
    known = shared.groupBy("mark", "size", "c1", "c2").agg(F.first("around").alias("around"))
    places = rows.where(F.size("places") > 0).select("ref", F.explode("places").alias("p")).select("ref", "p.*").distinct()
    met = places.join(known, ["mark", "size"]).select("ref", "size", "place", "near", "around", "c1", "c2")
    hits = store.store(met.mapInArrow(_extended, "ref string, a int, b int, c1 long, c2 long"), "hits")
    items = (
        hits.select("c1", "c2", "ref").distinct()
        .join(shared.where("item_id IS NOT NULL").select("c1", "c2", "item_id").distinct(), ["c1", "c2"])
        .groupBy("ref").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    none = F.array().cast("array<struct<a: int, b: int>>")
    merged = hits.groupBy("ref").agg(F.collect_set(F.struct("a", "b")).alias("hits")).mapInArrow(_merged, "ref string, spans array<struct<a: int, b: int>>")
    found = merged.join(items, "ref", "left")
    joined = rows.select("doc_id", "ref", "n_words").join(found, "ref", "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.aggregate(F.coalesce("spans", none), F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(item_ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", item_ids), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        item_ids.alias("item_ids"),
        F.coalesce("spans", none).alias("spans"),
        "ref",
    )


def without_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has no window of an item."""
    own = free_name(docs.columns, "hit_ref")
    hit = find_contamination(docs, benchmark, window).where("contaminated").select(F.col("ref").alias(own)).distinct()
    return docs.join(hit, _ref(docs) == F.col(own), "left_anti")
