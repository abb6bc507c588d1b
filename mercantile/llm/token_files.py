"""Token ids in files of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by doc_id; each task encodes its texts and writes segments. A segment holds
whole documents, about ``SEGMENT_IDS`` ids (more only if one document has more), and can be read on its own:

    4 bytes  the format's mark
    3 x 8    number of documents, ids and blocks
    per document   doc_id (8 bytes), whether it has one (1), number of ids (8)
    per block      smallest id (4), width in bits (1), number of outliers (2), start of the block in the body (8)
    body           blocks of ``BLOCK`` ids

A block subtracts its smallest id and packs the differences at the width that the given percentile of them needs.
What is wider is an outlier: its low bits are packed with the others, its high bits are in the block's exception list
(place, 1 byte, and high bits, 4 bytes). The last block of a segment is filled up with its smallest id. All numbers are
little-endian. Segments are rows of a Parquet table in the shared folder, so Spark's commit decides which attempt of a
task counts; (part, first) orders them, ``first`` being the ids of the part before the segment.

Defined results: NULL text counts as empty and has the end id only. Rows with equal doc_id are in the order of their
texts, rows without doc_id come first; however many they are, rows of different first letters are dealt to several tasks.
Very long texts are encoded whole. An empty table makes no segment; other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercantile.llm.parts import PartIds
from mercantile.llm.tables import scratch

MARK = b"PFR1"
BLOCK = 256
PERCENTILE = 90
SEGMENT_IDS = 1 << 16
END_ID = 2
_GROUP = 64
#: Parts of texts that one call of the tokenizer encodes.
_AT_ONCE = 50


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as rows of ``width`` 64-bit words."""
    out = np.zeros((len(values), width), dtype=np.uint64)
    for k in range(_GROUP):
        word, shift = divmod(k * width, 64)
        out[:, word] |= values[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, k] >> np.uint64(64 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), _GROUP), dtype=np.uint64)
    for k in range(_GROUP):
        word, shift = divmod(k * width, 64)
        out[:, k] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, k] |= words[:, word + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << width) - 1)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def encode_segment(doc_ids: np.ndarray, has_id: np.ndarray, counts: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A segment of the documents' ids, below 2**32, which stand one after the other in ``ids``."""
    n_blocks = -(-len(ids) // BLOCK)
    blocks = np.zeros((n_blocks, BLOCK), dtype=np.uint64)
    blocks.ravel()[: len(ids)] = ids
    if len(ids) % BLOCK:
        blocks[-1, len(ids) % BLOCK :] = blocks[-1, : len(ids) % BLOCK].min()
    least = blocks.min(axis=1)
    blocks -= least[:, None]
    rank = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    width = _widths(np.partition(blocks, rank, axis=1)[:, rank]) if n_blocks else np.zeros(0, np.int64)
    high = blocks >> width[:, None].astype(np.uint64)
    at_block, at_place = np.nonzero(high)
    outliers = np.bincount(at_block, minlength=n_blocks)
    sizes = width * (BLOCK // 8) + 5 * outliers
    start = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        low = (blocks[own] & np.uint64((1 << w) - 1)).reshape(-1, _GROUP)
        packed = _pack(low, w).astype("<u8").view(np.uint8).reshape(len(own), -1)
        body[start[own][:, None] + np.arange(packed.shape[1])] = packed
    list_at = start + width * (BLOCK // 8)
    nth = np.arange(len(at_block)) - (np.cumsum(outliers) - outliers)[at_block]
    body[list_at[at_block] + nth] = at_place
    highs = high[at_block, at_place].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(list_at + outliers)[at_block][:, None] + 4 * nth[:, None] + np.arange(4)] = highs
    numbers = np.array([len(doc_ids), len(ids), n_blocks], dtype="<u8")
    parts = [numbers, doc_ids.astype("<i8"), has_id.astype(np.uint8), counts.astype("<u8"), least.astype("<u4"), width.astype(np.uint8), outliers.astype("<u2"), start.astype("<u8"), body]
    return MARK + b"".join(p.tobytes() for p in parts)


class Segment:
    """A segment's tables, and its ids by block."""

    def __init__(self, raw: bytes):
        if raw[:4] != MARK:
            raise ValueError("not a token segment")
        self.raw, self.at = raw, 4
        n_docs, self.n_ids, n_blocks = (int(x) for x in self._take("<u8", 3))
        self.doc_ids, self.has_id, self.counts = self._take("<i8", n_docs), self._take("u1", n_docs) > 0, self._take("<u8", n_docs).astype(np.int64)
        self.least, self.width, self.outliers = self._take("<u4", n_blocks), self._take("u1", n_blocks).astype(np.int64), self._take("<u2", n_blocks).astype(np.int64)
        self.start = self._take("<u8", n_blocks).astype(np.int64)
        self.body = np.frombuffer(raw, dtype=np.uint8, offset=self.at)

    def _take(self, kind: str, n: int) -> np.ndarray:
        found = np.frombuffer(self.raw, dtype=kind, count=n, offset=self.at)
        self.at += found.nbytes
        return found

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from ``first`` to before ``last``; the index of starts makes others unread."""
        width, outliers, start = self.width[first:last], self.outliers[first:last], self.start[first:last]
        out = np.zeros((len(width), BLOCK), dtype=np.uint64)
        for w in np.unique(width[width > 0]).tolist():
            own = np.flatnonzero(width == w)
            raw = self.body[start[own][:, None] + np.arange(w * (BLOCK // 8))]
            out[own] = _unpack(np.ascontiguousarray(raw).view("<u8").reshape(-1, w), w).reshape(len(own), BLOCK)
        block = np.repeat(np.arange(len(width)), outliers)
        nth = np.arange(len(block)) - (np.cumsum(outliers) - outliers)[block]
        list_at = start + width * (BLOCK // 8)
        place = self.body[list_at[block] + nth]
        highs = np.ascontiguousarray(self.body[(list_at + outliers)[block][:, None] + 4 * nth[:, None] + np.arange(4)]).view("<u4").ravel()
        out[block, place] |= highs.astype(np.uint64) << width[block].astype(np.uint64)
        return (out + self.least[first:last, None]).astype(np.uint32).ravel()

    def ids(self) -> np.ndarray:
        return self.blocks(0, len(self.width))[: self.n_ids]

    def document(self, k: int) -> np.ndarray:
        """Ids of the segment's k-th document, from the blocks that hold it."""
        a = int(self.counts[:k].sum())
        b = a + int(self.counts[k])
        return self.blocks(a // BLOCK, -(-b // BLOCK))[a % BLOCK : a % BLOCK + b - a]


class Encoder:
    """Ids of texts, equal to those of the tokenizer for the whole text.

    Texts are cut into parts that a byte-level tokenizer encodes on their own (see ``parts``), and the parts' ids are remembered.
    A tokenizer of another kind encodes every text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cuts, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = spec["normalizer"] is None and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts["add_prefix_space"]
        plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.ids = PartIds(self._encode, [t["content"] for t in added], whole=not plain)
        # What stands on one side of an added token has no say in the ids of the other side, so it may divide parts that are encoded
        # in one call. It must be the only one and not begin within itself: then it begins at the dividers and within parts, nowhere else.
        alone = plain and len(added) == 1 and added[0]["content"][0] not in added[0]["content"][1:]
        alone &= spec["truncation"] is None and spec["padding"] is None
        self.divider, self.divider_id = (added[0]["content"], added[0]["id"]) if alone else (None, -1)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts, and each part's number of them."""
        texts = [p.decode() for p in parts]
        if self.divider is None or any(self.divider in t for t in texts):
            found = self._ids(texts)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes
        # Every joined text ends with a divider, so each part has one behind it.
        joined = [self.divider.join([*texts[k : k + _AT_ONCE], ""]) for k in range(0, len(texts), _AT_ONCE)]
        ids = np.fromiter(chain.from_iterable(self._ids(joined)), np.uint32)
        ends = np.flatnonzero(ids == self.divider_id)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the segments of all rows; the frame that reads them back: part, first, n_ids, segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        first, size = 0, 0
        held: list[tuple[np.ndarray, ...]] = []

        def written() -> pa.RecordBatch:
            raw = encode_segment(*(np.concatenate(x) for x in zip(*held, strict=True)))
            columns = [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "first", "n_ids", "segment"])

        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for begin, end, ids, ends in encoder.ids.texts(batch.column(1)):
                ids = np.insert(ids, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
                a = 0
                while a < end - begin:
                    # Documents up to the one that fills the segment.
                    b = min(end - begin, int(np.searchsorted(ends, ends[a] + SEGMENT_IDS - size)))
                    own = slice(begin + a, begin + b)
                    held.append((keys[own], known[own], np.diff(ends[a : b + 1]), ids[ends[a] : ends[b]]))
                    size += int(ends[b] - ends[a])
                    if size >= SEGMENT_IDS:
                        yield written()
                        first, size, held = first + size, 0, []
                    a = b
        if held:
            yield written()

    # The first letters tell rows of one doc_id apart, and are in the order of the texts; whole texts would all be sampled by the driver.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = chosen.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return scratch(docs.sparkSession).store(ordered.mapInArrow(run, "part int, first long, n_ids long, segment binary"), "tokens")


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = Segment(raw.as_py())
                ids, ends = found.ids().astype("<u4"), np.cumsum(found.counts)
                starts = ends - found.counts
                checks = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                columns = [np.full(len(ends), part, np.int32), first + starts, found.counts, np.array(checks, np.int64)]
                keys = pa.array(found.doc_ids, pa.int64(), mask=~found.has_id)
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns)], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    decoded = segments.select("part", "first", "segment").mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row per task that wrote
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")
    offsets = totals.select(F.col("part").alias("of"), before.alias("before"))
    return decoded.join(offsets, F.col("part") == F.col("of")).select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
