"""Spelling variants: words one edit apart, each pointing to a much more frequent one.

Words are distinct runs of letters with their numbers of occurrences.

1. Letters are hashed to ``SYMBOLS`` symbols. A word's reduced form is its string of symbols; words one edit apart have reduced forms at
   most one edit apart.
2. The whole one-edit neighbourhood of each reduced form (each place left out, replaced by each symbol, each gap filled with each, and the
   form itself) is joined with the reduced forms of the vocabulary. Few symbols make small neighbourhoods, but also many words
   of a form; so the key also holds half of the original word. Of two words one edit apart with at least 2k letters in the shorter
   one, the first k letters are equal if the edit is behind them, else the last k. A variant knows its edit's place and
   so which half it takes; a word of the vocabulary is entered under both, for each length of a neighbour.
3. Variants whose key no word has are dropped by a bitmap first; the join is exact without it, only longer.
4. Pairs are verified on the original strings.

All tables that grow with the vocabulary are joined by sorting, as the driver would have to hold what is broadcast, many times larger
than its file. What it holds is the bitmap alone, of at most 2 * 2**KNOWN_BITS bits (32 MB).

A word's form is its near word of the most occurrences (of equal ones the first in code-point order), if it has at least ``TIMES`` as many as the
word. Counts at least double from form to form, so the root is found by doubling pointers a few times.

Defined results: NULL and empty texts have no words; runs are taken whole, however long. Each row's words count, also those of repeated rows and
rows without doc_id (which counts as an empty string). An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.llm import sketch
from mercantile.llm.edits import code_points, one_edit_apart
from mercantile.llm.tables import scratch
from mercantile.llm.textkit import Hashes, lowered, mix, signed, slices

LEAST_LETTERS, LEAST_TIMES, TIMES = 5, 3, 2
MISSPELT = 97
SYMBOLS = 8
KNOWN_BITS = 27
_SLICE, _VARIANTS = 8 << 20, 600_000


def _crc_table() -> np.ndarray:
    """What a byte does to the state of a crc32: eight steps of division by its polynomial, bits reversed."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 texts."""
    folded = data | 0x20
    # U+00C0 to U+00FF are the characters whose first byte is 0xC3.
    lead = data == 0xC3
    inside = ((folded >= 0x61) & (folded <= 0x7A)) | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(at, start, side="right") - 1


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, behind bytes whose crc32 is ``before``."""
    size = end - start
    order = np.argsort(-np.minimum(size, 65).astype(np.int8), kind="stable")
    size, start, state = size[order], start[order], ~before[order]
    long = int(np.searchsorted(-size.clip(max=65), -64, side="left"))
    for k in range(int(size[long:].max(initial=0))):
        upto = int(np.searchsorted(-size.clip(max=65), -k, side="left"))
        part = state[long:upto]
        state[long:upto] = _TABLE[(part ^ data[start[long:upto] + k]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.empty(len(size), dtype=np.uint32)
    out[order] = ~state
    for k in range(long):
        row = order[k]
        out[row] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes(), int(before[row]))
    return out


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Spans, in order and apart, as a column of strings."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[start] += 1
    inside[end] -= 1
    kept = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def _counted(least: int, misspelt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, at in slices(batch.column(1), _SLICE):
                data = lowered(data)
                start, stop, text = letter_runs(data, at)
                heads = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in ids.slice(first, end - first).to_pylist()], dtype=np.uint32)
                checks = checksums(data, start, stop, heads[text])
                other = checks % misspelt == 0
                leads = np.r_[0, np.cumsum(data == 0xC3, dtype=np.int32)]
                letters = stop - start - (leads[stop] - leads[start])
                whole = ~other & (letters >= least)
                found = pc.value_counts(_spans(data, start[whole], stop[whole]))
                changed = []
                for k in np.flatnonzero(other & (letters > least)).tolist():
                    word, place = data[start[k] : stop[k]].tobytes().decode(), int(checks[k]) % int(letters[k])
                    changed.append(word[:place] + word[place + 1 :])
                again = pc.value_counts(pa.array(changed, pa.string()))
                columns = [pa.concat_arrays([found.field(k), again.field(k)]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n) of lower-cased runs (A-Z only) with enough letters and occurrences.

    Where ``misspelt`` divides the crc32 of '<doc_id>:<run>', the run counts without the letter at the checksum modulo its length.
    """
    chosen = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = chosen.mapInArrow(_counted(least_letters, misspelt), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


class _Reduced:
    """Words of a column, their reduced forms and the keys of both."""

    def __init__(self, words: pa.Array):
        self.chars, self.at = code_points(words)
        self.size = np.diff(self.at)
        self.symbols = (mix(self.chars.astype(np.uint64), 91) % np.uint64(SYMBOLS)).astype(np.uint8)
        self.forms, self.originals = Hashes(self.symbols), Hashes(self.chars.astype("<u4").view(np.uint8), 1)

    def keys(self, form: np.ndarray, word: np.ndarray, half: np.ndarray, at_end: np.ndarray) -> np.ndarray:
        """Keys of reduced forms made from words, with the first or last ``half`` letters of the words themselves."""
        begin = np.where(at_end, self.at[word + 1] - half, self.at[word])
        kept = self.originals.spans(4 * begin, 4 * (begin + half))
        return mix(form ^ mix(kept + (2 * half + at_end).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 92))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, key) under which each word is found."""
        n = len(self.size)
        form = self.forms.spans(self.at[:-1], self.at[1:])
        word, less, at_end = np.tile(np.arange(n), 4), np.repeat([0, 1, 0, 1], n), np.repeat([False, False, True, True], n)
        half = (self.size[word] - less) // 2
        kept = (self.size[word] > 0) & ~((less == 1) & (self.size[word] % 2 == 1))  # an odd length's two halves are equal
        word, half, at_end = word[kept], half[kept], at_end[kept]
        return word, self.keys(form[word], word, half, at_end)

    def variants(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, key) of every word's neighbourhood, in parts of bounded size."""
        # A word's places are its letters and its end; at each place: fill, replace, leave out.
        places = self.size + 1
        upto = np.r_[0, np.cumsum(places)]
        step = max(1, _VARIANTS // (2 * SYMBOLS + 1))
        for a in range(0, int(upto[-1]), step):
            spot = np.arange(a, min(a + step, int(upto[-1])))
            word = np.searchsorted(upto, spot, side="right") - 1
            place, size = spot - upto[word], self.size[word]
            letter = np.flatnonzero(place < size)
            begin, stop = self.at[word], self.at[word + 1]
            here = begin + place
            out = []
            for symbol in range(SYMBOLS):
                filled = self.forms.edited(begin, here, symbol, here, stop)
                out.append((word, filled, size // 2, place))
                replaced = letter[self.symbols[here[letter]] != symbol]
                form = self.forms.edited(begin[replaced], here[replaced], symbol, here[replaced] + 1, stop[replaced])
                out.append((word[replaced], form, size[replaced] // 2, place[replaced]))
            left = self.forms.without(begin[letter], here[letter], here[letter] + 1, stop[letter])
            out.append((word[letter], left, (size[letter] - 1) // 2, place[letter]))
            own, form, half, place = (np.concatenate(x) for x in zip(*out, strict=True))
            keys = self.keys(form, own, half, place < half)
            yield self._distinct(own, keys)
        # The form itself, for letters replaced by others of their symbol, in front or behind.
        n = len(self.size)
        word, at_end = np.tile(np.arange(n), 2), np.repeat([False, True], n)
        form = self.forms.spans(self.at[:-1], self.at[1:])
        yield word, self.keys(form[word], word, self.size[word] // 2, at_end)

    @staticmethod
    def _distinct(word: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((keys, word))
        word, keys = word[order], keys[order]
        new = np.ones(len(word), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | (keys[1:] != keys[:-1])
        return word[new], keys[new]


def _keyed(batch: pa.RecordBatch, word: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(word), 50_000):
        own = batch.take(pa.array(word[a : a + 50_000]))
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys[a : a + 50_000])), *own.columns], ["key", "word", "n"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, _, _ in slices(batch.column(0)):
            part = batch.slice(first, end - first)
            yield from _keyed(part, *_Reduced(part.column(0)).entries())


def _variants(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in slices(batch.column(0), 1 << 18):
                part = batch.slice(first, end - first)
                for word, keys in _Reduced(part.column(0)).variants():
                    kept = known.value.test(mix(keys))
                    yield from _keyed(part, word[kept], keys[kept])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.filter(pa.array(one_edit_apart(batch.column(0), batch.column(2))))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of every two words of (word, n) one edit apart, in both orders."""
    spark = words.sparkSession
    store = scratch(spark)
    entries = store.store(words.select("word", "n").mapInArrow(_entries, "key long, word string, n long"), "entries")
    known = sketch.members(entries, "key", min(KNOWN_BITS, sketch.bits_for(8 * entries.count())))
    asked = words.select("word", "n").mapInArrow(_variants(spark.sparkContext.broadcast(known)), "key long, word string, n long")
    others = entries.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = asked.join(others.hint("merge"), "key").where("word <> other").select("word", "n", "other", "other_n")
    return met.mapInArrow(_verified, "word string, n long, other string, other_n long").distinct()


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of every row of (word, form): the last word that forms lead to. Each round doubles the steps taken."""
    store = scratch(formed.sparkSession)
    at = store.store(formed.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("step"), F.col("root").alias("next"))
        moved = store.store(at.join(on.hint("merge"), F.col("root") == F.col("step"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return at
        at = moved.select("word", "root")


def group_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    store = scratch(docs.sparkSession)
    words = store.store(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best)
    form = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.other"))
    near = store.store(near.select(F.col("word").alias("of"), "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "near")
    last = roots(near.where("form IS NOT NULL").select(F.col("of").alias("word"), "form")).withColumnRenamed("word", "at")
    met = words.join(near.hint("merge"), F.col("word") == F.col("of"), "left").join(last.hint("merge"), F.col("word") == F.col("at"), "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
