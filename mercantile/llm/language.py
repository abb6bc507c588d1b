"""Language of documents by hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1, fixed by its code point. A trigram's vector binds the letters' vectors by
multiplication, each permuted (rotated) by its place. A text's vector bundles, that is adds, the vectors of its trigrams;
a language's prototype bundles its texts. The language whose prototype has the largest cosine with the text is predicted.

Text is lower-cased; every run of characters that are no letters counts as one blank, also at either end.
Bundling a language adds counts of trigrams first, so a trigram's vector is added once per batch.

Defined results: a NULL text or one without a letter is ``und`` with score 0; without anything learned every text is
``und``. Equal cosines go to the language that sorts first. Rows with NULL lang are predicted, not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
UNKNOWN = "und"
_BLANK = 32
_SLICE_CHARS = 1 << 20
#: Trigram vectors that a worker keeps at most: 64 MB.
_KEPT = 16_384


def _letters(code_points: np.ndarray) -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(len(code_points), dtype=np.uint32)
    for k, c in enumerate(code_points.tolist()):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            out[k] = ord(low) if len(low) == 1 else c
    return out


_BASIC = _letters(np.r_[np.arange(0xD800), np.full(0x800, 32), np.arange(0xE000, 0x10000)])


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, trigram) of every trigram of letters and blanks that has a letter."""
    joined = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts])
    which = np.repeat(np.arange(len(texts) + 1), np.r_[1, sizes + 1])  # a text's characters and the line feed behind it, first of all one line feed
    which = np.maximum(which - 1, 0)
    low = np.zeros(len(joined), dtype=np.uint32)
    basic = joined < 0x10000
    low[basic] = _BASIC[joined[basic]]
    if not basic.all():
        low[~basic] = _letters(joined[~basic])
    blank = low == 0
    low[blank] = _BLANK
    kept = ~blank
    kept[1:] |= ~blank[:-1]
    kept[0] = True
    low, which = low[kept].astype(np.uint64), which[kept]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = (low[:-2] << np.uint64(42)) | (low[1:-1] << np.uint64(21)) | low[2:]
    middle = low[1:-1] != _BLANK  # the blank between two words ends one gram and begins another; one around it would cross words
    return which[1:-1][middle], grams[middle]


class TrigramVectors:
    """Vectors of trigrams, made on demand and kept up to a bound."""

    def __init__(self, dimensions: int):
        self.dimensions, self.letters = dimensions, {}
        self.known, self.rows, self.used = np.zeros(0, np.uint64), np.zeros((0, dimensions), np.float32), 0

    def letter(self, code_point: int) -> np.ndarray:
        if code_point not in self.letters:
            self.letters[code_point] = np.random.Generator(np.random.PCG64(code_point)).integers(0, 2, self.dimensions).astype(np.float32) * 2 - 1
        return self.letters[code_point]

    def make(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def get(self, grams: np.ndarray) -> np.ndarray:
        """The rows of sorted distinct trigrams."""
        if len(self.letters) > _KEPT:
            self.letters = {}
        missing = np.setdiff1d(grams, self.known, assume_unique=True)
        if len(missing):
            if len(self.known) + len(missing) > _KEPT:
                self.known, self.rows, missing = grams[:0], self.rows[:0], grams
            known = np.concatenate([self.known, missing])
            order = np.argsort(known)
            made = np.stack([self.make(int(g)) for g in missing])
            self.known, self.rows = known[order], np.concatenate([self.rows, made])[order]
        return self.rows[np.searchsorted(self.known, grams)]


_VECTORS: dict[int, TrigramVectors] = {}


def _vectors(dimensions: int) -> TrigramVectors:
    return _VECTORS.setdefault(dimensions, TrigramVectors(dimensions))


def _slices(texts: list) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= _SLICE_CHARS:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def _counted(which: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams; and (group, place of the trigram, count), sorted by group."""
    distinct, place = np.unique(grams, return_inverse=True)
    slots, counts = np.unique(which * max(len(distinct), 1) + place, return_counts=True)
    return distinct, slots // max(len(distinct), 1), slots % max(len(distinct), 1), counts


def bundle(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One vector per text."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    distinct, group, place, counts = _counted(*trigrams(texts))
    if len(distinct):
        rows = _vectors(dimensions).get(distinct)
        bounds = np.searchsorted(group, np.arange(len(texts) + 1))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            out[k] = counts[a:b].astype(np.float32) @ rows[place[a:b]]
    return out


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, of unit length. A task sends one vector per language; they are added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            for first, part in _slices(texts):
                which, grams = trigrams(part)
                distinct, group, place, counts = _counted(code[first + which], grams)
                rows = _vectors(dimensions).get(distinct) if len(distinct) else None
                for g in np.unique(group):
                    own = group == g
                    vector = total.setdefault(names[g], np.zeros(dimensions))
                    vector += counts[own] @ rows[place[own]].astype(np.float64)
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector)], ["lang", "at", "value"])

    learned = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = learned.mapInArrow(run, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).select("lang", "v.value").collect()
    found = sorted((r["lang"], np.array(r["value"])) for r in found)
    if not found:
        return [], np.zeros((0, dimensions), np.float32)
    vectors = np.stack([v for _, v in found])
    return [x for x, _ in found], (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], vectors: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``; the score is the cosine, not below 0."""
    dimensions = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column(1).to_pylist()):
                own = bundle(texts, dimensions)
                length = np.linalg.norm(own, axis=1)
                near = own @ vectors.T / np.maximum(length, 1e-12)[:, None] if langs else np.zeros((len(texts), 1))
                best = near.argmax(axis=1)
                some = [any(c.isalpha() for c in t) for t in texts]
                names = [langs[b] if langs and s else UNKNOWN for b, s in zip(best, some, strict=True)]
                scores = np.where(np.array(some) & bool(langs), np.clip(near[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose crc32 of doc_id, modulo 4, is not 2."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2, F.lit(False))
    langs, vectors = prototypes(docs.where(~held), dimensions)
    found = predict(docs, langs, vectors)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
