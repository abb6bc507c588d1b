"""Removal of lines that repeat an earlier line, exactly or but for one character.

The bound is one edit: a character replaced, inserted or left out. Lines are judged on the input; the earliest, by doc_id
and line number, of the lines within one edit of each other stays, each other line that has an earlier one goes.

1. Two lines within one edit share their first or last half. A count-min sketch of all halves drops lines that share
   neither with any other line: they can't have a partner.
2. Equal lines are grouped by a 128-bit hash; the first occurrence stands for them, the others go. Before the shuffle a task
   keeps only its earliest of equal lines as a question.
3. Of each distinct line all variants with one character left out are keyed by their hash. A second sketch drops keys that
   only one line has. Lines meet by equal keys: with the same character place, they differ in that character; with a line
   that is the variant itself, by one character more. So each line needs only the earliest of what it meets, no pairs.
4. That the earliest line is one edit apart is verified on the texts, from both ends, in time linear in their lengths.
5. Texts are read once more. Only those that lose lines are shuffled to meet their line numbers.

Lines of fewer than ``least`` characters are compared exactly only: one edit is a large part of a short line ('No' and 'So').
They take one key, the whole line, in the first sketch, and have no variants. Those of fewer than ``exact`` characters are not
compared at all; with ``exact`` 1 every line is that has a character other than a blank.

Defined results: NULL text has no lines, an empty text one empty line; lines end at line feeds. Lines of blanks (space, tab to
carriage return) alone with fewer than ``least`` characters always stay. Rows without doc_id lose no lines and remove none.
Rows with equal doc_id are in the order of a hash of their texts, equal rows count once. Very long lines are compared whole; an empty
table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercantile.llm import sketch
from mercantile.llm.edits import one_edit_apart
from mercantile.llm.tables import scratch
from mercantile.llm.textkit import Hashes, hash_spans, mix, signed, slices

LEAST_CHARS = 16
_ASKED = 150_000
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def _lines(data: np.ndarray, at: np.ndarray):
    """(start, end, text, number, first character, characters) of every line of the texts, and where characters start."""
    feeds = np.flatnonzero(data == 10)
    text = np.searchsorted(at, feeds, side="right") - 1
    some = np.flatnonzero(np.diff(at) > 0)
    start = np.r_[at[some], feeds + 1]
    end = np.r_[at[some + 1], feeds]
    owner = np.r_[some, text]
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    # A line ends where the text's next one begins, less the line feed; a text's last line ends with the text.
    last = np.r_[owner[1:] != owner[:-1], np.ones(min(1, len(owner)), bool)]
    end = np.where(last, at[owner + 1], np.r_[start[1:] - 1, np.zeros(min(1, len(start)), np.int64)])
    number = np.arange(len(start)) - np.searchsorted(owner, owner)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(chars, start)
    return start, end, owner, number, first, np.searchsorted(chars, end) - first, chars


def _halves(data: np.ndarray, sums: Hashes, start, end, first, size, chars) -> np.ndarray:
    """Keys of the first and last halves, for the halves of a line and of one with a character less; a row per line."""
    out = []
    bound = np.r_[chars, len(data)]
    for h in (size // 2, (size - 1) // 2):
        tag = h.astype(np.uint64) * _PLACE
        out.append(mix(sums.spans(start, bound[first + h]) + tag, 1))
        out.append(mix(sums.spans(bound[first + size - h], end) + tag, 2))
    out[2][(size // 2) == ((size - 1) // 2)] = out[0][(size // 2) == ((size - 1) // 2)]
    out[3][(size // 2) == ((size - 1) // 2)] = out[1][(size // 2) == ((size - 1) // 2)]
    return np.stack(out, axis=1)


def _judged_lines(data: np.ndarray, at: np.ndarray, least: int, exact: int):
    """The compared lines with their four keys: the halves, or four times the whole of a line of fewer than ``least`` characters."""
    start, end, owner, number, first, size, chars = _lines(data, at)
    own = size >= least
    if exact < least:
        filled = np.r_[0, np.cumsum((data != 32) & ((data < 9) | (data > 13)), dtype=np.int32)]
        own |= (size >= exact) & (filled[end] > filled[start])
    start, end, owner, number, first, size = (x[own] for x in (start, end, owner, number, first, size))
    long, sums = size >= least, Hashes(data)
    keys = np.empty((len(size), 4), dtype=np.uint64)
    keys[long] = _halves(data, sums, start[long], end[long], first[long], size[long], chars)
    keys[~long] = mix(sums.spans(start[~long], end[~long]), 3)[:, None]
    return start, end, owner, number, sums, keys, size


def _sketched(least: int, exact: int, bits: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                *_, keys, size = _judged_lines(data, at, least, exact)
                long, even = size >= least, size % 2 == 0
                yield np.concatenate([keys[long, :2].ravel(), keys[long & even, 2:].ravel(), keys[~long, 0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch.cell_batches(hashes(batches), bits, 2)

    return run


def _refs(ids: np.ndarray, sums: Hashes, at: np.ndarray) -> np.ndarray:
    """What tells rows of one doc_id apart: a hash of the whole text. Rows are joined on doc_id and this."""
    return signed(mix(sums.spans(at[:-1], at[1:]) ^ mix(ids.view(np.uint64), 77)))


_ASK = "h1 long, h2 long, doc_id long, ref long, number int, line string, known boolean"
_ASK_NAMES = ["h1", "h2", "doc_id", "ref", "number", "line", "known"]


def _asked(least: int, exact: int, repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def written() -> Iterator[pa.RecordBatch]:
            h1, h2, doc, ref, number = (np.concatenate([p[k] for p in held]) for k in range(5))
            lines = [x for p in held for x in p[5]]
            order = np.lexsort((number, ref, doc, h2, h1))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            known = np.ones(len(order), dtype=bool)
            known[order[new]] = False
            # A repeated row's lines are the same lines, not repetitions of them.
            head = order[new][np.cumsum(new) - 1]
            known[order] &= (ref[order] != ref[head]) | (number[order] != number[head])
            spread = np.where(known, mix(ref.view(np.uint64) + number.astype(np.uint64)).view(np.int64), h1)
            for a in range(0, len(doc), 20_000):
                cut = slice(a, a + 20_000)
                texts = pa.array([None if k else x for x, k in zip(lines[cut], known[cut], strict=True)], pa.string())
                columns = [pa.array(spread[cut]), pa.array(h2[cut]), pa.array(doc[cut]), pa.array(ref[cut]), pa.array(number[cut], pa.int32()), texts, pa.array(known[cut])]
                yield pa.RecordBatch.from_arrays(columns, _ASK_NAMES)

        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for begin, stop, data, at in slices(batch.column(1)):
                start, end, owner, number, sums, keys, _ = _judged_lines(data, at, least, exact)
                kept = repeated.value.test(keys.ravel()).reshape(-1, 4).any(axis=1)
                if not kept.any():
                    continue
                start, end, owner, number = (x[kept] for x in (start, end, owner, number))
                whole, second = sums.spans(start, end), hash_spans(data, start, end, 1)
                texts = [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
                refs = _refs(ids[begin:stop], sums, at)
                held.append((signed(mix(whole, 5)), signed(mix(second, 6)), ids[begin:stop][owner], refs[owner], number, texts))
                size += len(texts)
                if size >= _ASKED:
                    yield from written()
                    held, size = [], 0
        if held:
            yield from written()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by line and occurrence: the first keeps its text and stands for the line, the others are known to go."""
    last = None
    for batch in batches:
        h1, h2, doc, ref, number = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
        known = batch.column(6).to_numpy(zero_copy_only=False).copy()
        keep = np.ones(len(h1), dtype=bool)
        for k in np.flatnonzero(~known).tolist():
            key = (h1[k], h2[k])
            if last is not None and last[0] == key:
                known[k] = True
                keep[k] = last[1] != (ref[k], number[k])
            else:
                last = (key, (ref[k], number[k]))
        out = batch.set_column(6, "known", pa.array(known))
        yield out.filter(pa.array(keep))


def _variant_keys(lines: pa.Array, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line index, place or -1, key) of every line itself and of every variant, for slices of lines. A run of one character
    gives equal variants: with ``once`` the first of them, else one for each place."""
    for first, _, data, at in slices(lines, 1 << 18):
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        line = np.searchsorted(at, chars, side="right") - 1
        begin, stop = at[line], at[line + 1]
        follows = np.minimum(np.r_[chars[1:], len(data)], stop)
        width = follows - chars
        sums = Hashes(data)
        key, own = mix(sums.without(begin, chars, follows, stop), 9), mix(sums.spans(at[:-1], at[1:]), 9)
        place = np.arange(len(chars)) - np.searchsorted(line, line)
        fresh = np.ones(len(key), dtype=bool)
        if once:
            fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        n = len(at) - 1
        yield np.r_[line[fresh], np.arange(n)] + first, np.r_[place[fresh], np.full(n, -1)], np.r_[key[fresh], own]


def _variant_cells(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch.cell_batches((key for b in batches for _, _, key in _variant_keys(b.column(0), True)), bits, 2)

    return run


def _variant_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, place, key in _variant_keys(batch.column(5), False):
                kept = shared.value.test(key)
                line, place, key = line[kept], place[kept], key[kept]
                for a in range(0, len(line), 50_000):
                    cut = slice(a, a + 50_000)
                    own = batch.select(["h1", "h2", "doc_id", "ref", "number"]).take(pa.array(line[cut]))
                    columns = [pa.array(signed(key[cut])), pa.array(place[cut], pa.int32()), *own.columns]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "place", "h1", "h2", "doc_id", "ref", "number"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch.select(["doc_id", "ref", "number"]).filter(pa.array(one_edit_apart(batch.column(3), batch.column(4))))


def removed_lines(docs: DataFrame, least: int = LEAST_CHARS, exact: int | None = None) -> DataFrame:
    """(doc_id, ref, number) of every line that goes: lines of ``least`` characters within one edit, of ``exact`` (``least``) if equal."""
    exact = least if exact is None else exact
    spark = docs.sparkSession
    store = scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(size // 16)
    halves = sketch.merge(docs.select("text").mapInArrow(_sketched(least, exact, bits), sketch.CELL_SCHEMA), bits, 2, twice=True)
    asked = docs.mapInArrow(_asked(least, exact, spark.sparkContext.broadcast(halves)), _ASK)
    order = ["h1", "h2", "known", "doc_id", "ref", "number"]
    answered = asked.repartition("h1", "h2").sortWithinPartitions(*order).mapInArrow(_answered, _ASK)
    answered = store.store(answered, "lines")

    lines = answered.where(~F.col("known") & (F.length("line") >= least))
    size = lines.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    bits = sketch.bits_for(size // 2)
    shared = sketch.merge(lines.select("line").mapInArrow(_variant_cells(bits), sketch.CELL_SCHEMA), bits, 2, twice=True)
    rows = lines.mapInArrow(_variant_rows(spark.sparkContext.broadcast(shared)), "key long, place int, h1 long, h2 long, doc_id long, ref long, number int")
    at = F.struct("doc_id", "ref", "number", "h1", "h2")
    own, same_place = Window.partitionBy("key"), Window.partitionBy("key", "place")
    whole = F.min(F.when(F.col("place") < 0, at)).over(own)
    longer = F.min(F.when(F.col("place") >= 0, at)).over(own)
    replaced = F.min(at).over(same_place)
    earlier = F.when(F.col("place") < 0, longer).otherwise(F.least(replaced, whole))
    pairs = rows.select("h1", "h2", at.alias("at"), earlier.alias("earlier")).where("earlier < at")
    pairs = pairs.select("h1", "h2", F.col("earlier.h1").alias("e1"), F.col("earlier.h2").alias("e2")).distinct()
    texts = lines.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("other"))
    met = pairs.join(texts, ["e1", "e2"]).join(lines.select("h1", "h2", "doc_id", "ref", "number", "line"), ["h1", "h2"])
    near = met.select("doc_id", "ref", "number", "line", "other").mapInArrow(_verified, "doc_id long, ref long, number int")
    return answered.where("known").select("doc_id", "ref", "number").unionByName(near).distinct()


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b"\n".join(parts)).hexdigest()


def _finished(hit, with_text: bool):
    """Finished rows of texts that lose nothing; the text of the others goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for first, end, data, at in slices(batch.column(1)):
                refs = _refs(ids[first:end], Hashes(data), at)
                may = valid[first:end] & ((known[first:end] & hit.value.test(mix(refs.view(np.uint64)))) | with_text)
                texts, counts, digests = [], [], []
                for row in range(end - first):
                    raw = data[at[row] : at[row + 1]].tobytes()
                    texts.append(raw.decode() if may[row] else None)
                    counts.append(None if may[row] else raw.count(b"\n") + 1 if valid[first + row] else 0)
                    digests.append(None if may[row] else hashlib.sha256(raw).hexdigest())
                columns = [batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(refs), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "ref", "text", "n_lines", "kept_sha256"])

    return run


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, n_lines, digest, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept_text, n_removed = None, 0
                if text is not None:
                    lines, gone = text.encode().split(b"\n"), set(numbers or ())
                    kept = [x for k, x in enumerate(lines) if k not in gone]
                    n_lines, n_removed, digest = len(lines), len(lines) - len(kept), _digest(kept)
                    kept_text = b"\n".join(kept).decode()
                rows.append((doc_id, n_lines, n_removed, digest) + ((kept_text,) if with_text else ()))
            names = ["doc_id", "n_lines", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, with_text: bool = False, exact: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by line feeds) of every row; on demand kept_text."""
    spark = docs.sparkSession
    store = scratch(spark)
    gone = store.store(removed_lines(docs, least, exact).groupBy("doc_id", "ref").agg(F.collect_list("number").alias("numbers")), "gone")
    hit = sketch.members(gone, "ref", sketch.bits_for(gone.count() * 2))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = chosen.mapInArrow(_finished(spark.sparkContext.broadcast(hit), with_text), "doc_id long, ref long, text string, n_lines long, kept_sha256 string")
    met = rows.join(gone, ["doc_id", "ref"], "left").select("doc_id", "text", "n_lines", "kept_sha256", "numbers")
    return met.mapInArrow(_cut(with_text), "doc_id long, n_lines long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
