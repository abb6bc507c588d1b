"""Removal of repeated word windows, with a count-min sketch in front of the exact grouping.

1. Every task hashes all windows of its texts into sketch cells; the merged sketch overestimates how often a
   window occurs. It is sized by the bytes of the text column and bounded, see ``sketch``.
2. A second pass over the texts drops windows whose estimate is one occurrence: they can't be repeated. The
   others are grouped exactly by a 96-bit hash of their words. Before the shuffle a task keeps, of equal windows,
   only one of the smallest doc_id as a question; for the others the answer is known. So a passage that
   a third of all documents share sends one row per task and few million windows, not one per document.
3. Sorted by window, the first row has the smallest doc_id; rows with a larger one are removed.
4. Texts are read once more. Only those that lose words are shuffled to meet their positions.

Defined results: NULL or empty text has no words; a text of fewer than ``window`` words loses none. Rows with
equal doc_id are judged each by its own text, and neither removes words of the other. A row without doc_id
loses nothing and removes nothing. Repeats within one document stay. Very long texts are judged whole; an empty table gives no rows;
columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.llm import sketch
from mercantile.llm.tables import scratch
from mercantile.llm.textkit import BLANK_SEPARATED, Hashes, find_words, hash_runs, mix, run_starts, signed, slices

WINDOW = 13
_ASKED = 1_000_000
#: ``rest``: 32 more bits of the window's hash, 31 bits of the place and whether the answer is known. Narrow rows, as there are many.
_ASK = pa.schema([("h1", pa.int64()), ("rest", pa.int64()), ("doc_id", pa.int64()), ("ref", pa.int64())])
_REMOVED = pa.schema([("doc_id", pa.int64()), ("ref", pa.int64()), ("place", pa.int32())])
_JUDGED = pa.schema([("doc_id", pa.int64()), ("ref", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("kept_sha256", pa.string())])


def _windows(data: np.ndarray, at: np.ndarray, window: int):
    words = find_words(data, at, BLANK_SEPARATED)
    sums = Hashes(data)
    return words, sums.spans(words.start, words.end), run_starts(words, window), sums


def _refs(ids: np.ndarray, sums: Hashes, at: np.ndarray) -> np.ndarray:
    """What tells rows of one doc_id apart: a hash of the whole text. Rows are joined on doc_id and this."""
    return signed(mix(sums.spans(at[:-1], at[1:]) ^ mix(ids.view(np.uint64), 77)))


def _sketched(window: int, bits: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                _, found, starts, _ = _windows(data, at, window)
                yield hash_runs(found, window, 1)[starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch.cell_batches(hashes(batches), bits, 2)

    return run


def _asked(window: int, repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def written() -> Iterator[pa.RecordBatch]:
            h1, h2, doc, ref, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, h2, h1))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            least = doc[order][new][np.cumsum(new) - 1]
            known = np.zeros(len(order), dtype=bool)
            known[order] = doc[order] > least
            # Of several rows with the smallest doc_id all ask, but a second one in the same text need not be sent twice.
            spread = np.where(known, mix(ref.view(np.uint64) + place.astype(np.uint64)).view(np.int64), h1)
            rest = (h2.astype(np.int64) << 32) | (place.astype(np.int64) << 1) | known
            for a in range(0, len(doc), 100_000):
                cut = slice(a, a + 100_000)
                columns = [spread[cut], rest[cut], doc[cut], ref[cut]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ASK)

        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, data, at in slices(batch.column(1)):
                words, hashes, starts, sums = _windows(data, at, window)
                h1 = hash_runs(hashes, window, 1)[starts]
                kept = repeated.value.test(h1)
                if not kept.any():
                    continue
                starts, h1 = starts[kept], h1[kept]
                h2 = (hash_runs(hashes, window, 2)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                text = words.text[starts]
                refs = _refs(ids[first:end], sums, at)
                held.append((signed(h1), h2, ids[first:end][text], refs[text], (starts - words.first[text]).astype(np.int32)))
                size += len(h1)
                if size >= _ASKED:
                    yield from written()
                    held, size = [], 0
        if held:
            yield from written()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window and doc_id: a row is removed if its window's first row has a smaller doc_id."""
    last = None
    for batch in batches:
        h1, rest, doc, ref = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(doc):
            continue
        h2, place, known = rest >> 32, ((rest >> 1) & 0x7FFFFFFF).astype(np.int32), (rest & 1).astype(bool)
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (known[1:] != known[:-1])
        key = (h1[0], h2[0], known[0])
        carried = last is not None and last[0] == key
        group = np.cumsum(new) - 1
        least = doc[new]
        if carried:
            least[0] = last[1]
        gone = known | (doc > least[group])
        last = ((h1[-1], h2[-1], known[-1]), least[-1])
        if gone.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(ref[gone]), pa.array(place[gone])], schema=_REMOVED)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _judged(hit, with_text: bool):
    """Finished rows of texts that lose nothing; the text of the others goes on to meet its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, data, at in slices(batch.column(1)):
                refs = _refs(ids[first:end], Hashes(data), at)
                may = known[first:end] & hit.value.test(mix(refs.view(np.uint64)))
                if with_text:
                    may |= batch.column(1).slice(first, end - first).is_valid().to_numpy(zero_copy_only=False)
                texts, counts, digests = [], [], []
                for row in range(end - first):
                    raw = data[at[row] : at[row + 1]].tobytes()
                    words = raw.split() if not may[row] else []
                    texts.append(raw.decode() if may[row] else None)
                    counts.append(None if may[row] else len(words))
                    digests.append(None if may[row] else _digest(words))
                columns = [batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(refs), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(digests, pa.string())], schema=_JUDGED)

    return run


def _finished(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, n_words, digest, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept_text = None
                if text is not None:
                    words = text.encode().split()
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    if places:
                        at = np.array(places)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + window, -1)
                    covered = np.cumsum(edges)[:-1] > 0
                    kept = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
                    n_words, digest, n_removed = len(words), _digest(kept), len(words) - len(kept)
                    kept_text = b" ".join(kept).decode() if with_text and n_removed else text
                else:
                    n_removed = 0
                rows.append((doc_id, n_words, n_removed, digest) + ((kept_text,) if with_text else ()))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def removed_places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, ref, place): the first word of each window that a document with a smaller doc_id has too."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(size // 8)
    repeated = sketch.merge(docs.select("text").mapInArrow(_sketched(window, bits), sketch.CELL_SCHEMA), bits, 2, twice=True)
    asked = docs.mapInArrow(_asked(window, spark.sparkContext.broadcast(repeated)), "h1 long, rest long, doc_id long, ref long")
    by_window = ["h1", F.shiftright("rest", 32), F.col("rest").bitwiseAND(1), "doc_id"]
    return asked.repartition("h1").sortWithinPartitions(*by_window).mapInArrow(_answered, "doc_id long, ref long, place int")


def dedup_windows(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``; with ``with_text`` also kept_text.

    kept_text is the unchanged text where nothing was removed, and the kept words joined by one space otherwise.
    """
    spark = docs.sparkSession
    places = removed_places(docs, window).groupBy("doc_id", "ref").agg(F.sort_array(F.collect_list("place")).alias("places"))
    places = scratch(spark).store(places, "places")
    hit = sketch.members(places, "ref", sketch.bits_for(places.count() * 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _judged(spark.sparkContext.broadcast(hit), with_text), "doc_id long, ref long, text string, n_words long, kept_sha256 string"
    )
    met = rows.join(places, ["doc_id", "ref"], "left").select("doc_id", "text", "n_words", "kept_sha256", "places")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return met.mapInArrow(_finished(window, with_text), schema)
