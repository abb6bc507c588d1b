"""Count-min sketches and membership bitmaps, built by tasks and merged by Spark.

Each task turns 64-bit hashes into cells, one per sketch row, and writes the cells it met, with those it
met more than once, as sorted gaps by segment. Tasks that own segments merge them. What is kept of a
merged cell is one bit: met at all (``Bits`` for membership), or met at least twice (``Bits`` for
repetition). Both err on one side only: a hash that was met, or met twice, always has its bits set.

The merged bits have a fixed size, at most 2 * 2**MOST_BITS bits, whatever the input, and are the only thing
that is broadcast. Where the input is larger than the sketch was sized for, more hashes pass that need not,
and the exact step behind it has more to do; its result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.llm.textkit import mix

SEGMENTS = 128
LEAST_BITS, MOST_BITS = 16, 30
_ROW_SALTS = (0, 0x5851F42D4C957F2D)
_HELD = 2_000_000
_CELLS = pa.schema([("line", pa.int32()), ("segment", pa.int32()), ("met", pa.binary()), ("again", pa.binary())])
CELL_SCHEMA = "line int, segment int, met binary, again binary"


def bits_for(count: int) -> int:
    """Cells of a row as a power of two: about twice to four times ``count``, within the fixed bounds."""
    return int(np.clip(int(max(count, 1)).bit_length() + 1, LEAST_BITS, MOST_BITS))


def cells(hashes: np.ndarray, line: int, bits: int) -> np.ndarray:
    spread = mix(hashes, _ROW_SALTS[line]) if line else hashes
    return (spread >> np.uint64(64 - bits)).astype(np.uint32)


def _gaps(found: np.ndarray, bits: int) -> list[bytes]:
    """Sorted distinct cells as the gaps between them, a part for each segment. 255 stands for a gap to go on."""
    size = (1 << bits) // SEGMENTS
    bounds = np.searchsorted(found, np.arange(SEGMENTS + 1, dtype=np.int64) * size)
    steps = np.diff(found.astype(np.int64), prepend=0)
    firsts = bounds[:-1][np.diff(bounds) > 0]
    steps[firsts] = found[firsts] % size
    ends = np.cumsum(steps // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, dtype=np.uint8)
    out[ends - 1] = steps % 255
    at = np.concatenate([[0], ends])[bounds]
    return [out[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _places(gaps: bytes) -> np.ndarray:
    steps = np.frombuffer(gaps, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def cell_batches(hashes: Iterable[np.ndarray], bits: int, lines: int) -> Iterator[pa.RecordBatch]:
    """A task's cells. Memory is bounded: what has been gathered is written every few million hashes."""
    held, size = [], 0

    def written() -> Iterator[pa.RecordBatch]:
        together = np.concatenate(held)
        for line in range(lines):
            found, times = np.unique(cells(together, line, bits), return_counts=True)
            met, again = _gaps(found, bits), _gaps(found[times > 1], bits)
            columns = [np.full(SEGMENTS, line, np.int32), np.arange(SEGMENTS, dtype=np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(met, pa.binary()), pa.array(again, pa.binary())], schema=_CELLS)

    for part in hashes:
        if len(part):
            held.append(part)
            size += len(part)
        if size >= _HELD:
            yield from written()
            held, size = [], 0
    if held:
        yield from written()


def _merged(twice: bool, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge rows sorted by line and segment, one segment in memory at a time."""
    size = (1 << bits) // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple[int, int], kept: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(kept).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["line", "segment", "bits"])

        open_key = None
        for batch in batches:
            for line, segment, met, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (line, segment) != open_key:
                    if open_key:
                        yield done(open_key, kept if twice else seen)
                    open_key, seen, kept = (line, segment), np.zeros(size, bool), np.zeros(size, bool)
                places = _places(met)
                if twice:
                    kept[places] |= seen[places]
                    kept[_places(again)] = True
                seen[places] = True
        if open_key:
            yield done(open_key, kept if twice else seen)

    return run


class Bits:
    """Merged bits, to be broadcast: at most 2 * 2**MOST_BITS bits."""

    def __init__(self, bits: int, lines: int):
        self.bits, self.lines = bits, lines
        self.packed = np.zeros((lines, (1 << bits) // 8), dtype=np.uint8)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        kept = np.ones(len(hashes), dtype=bool)
        for line in range(self.lines):
            at = cells(hashes[kept], line, self.bits)
            kept[kept] = (self.packed[line][at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & np.uint8(1) > 0
        return kept


def merge(written: DataFrame, bits: int, lines: int, twice: bool) -> Bits:
    """The merged bits of a frame of ``cell_batches``. They come to the driver: a fixed size, see above."""
    rows = (
        written.repartition("line", "segment")
        .sortWithinPartitions("line", "segment")
        .mapInArrow(_merged(twice, bits), "line int, segment int, bits binary")
    )
    out, size = Bits(bits, lines), (1 << bits) // SEGMENTS // 8
    for row in rows.toLocalIterator(prefetchPartitions=False) if bits > 28 else rows.collect():
        out.packed[row["line"], row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def members(keys: DataFrame, column: str, bits: int, lines: int = 2) -> Bits:
    """Bits of all values of a long column; NULL has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cell_batches((mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) for b in batches), bits, lines)

    chosen = keys.select(F.col(column).cast("long").alias("key")).where("key IS NOT NULL")
    return merge(chosen.mapInArrow(run, CELL_SCHEMA), bits, lines, twice=False)


def is_member(found: Bits, values: pa.Array) -> np.ndarray:
    """Whether each value of a long column may be a member; NULL never is."""
    if not len(values):
        return np.zeros(0, dtype=bool)
    known = values.is_valid().to_numpy(zero_copy_only=False)
    filled = values.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return known & found.test(mix(filled.view(np.uint64)))
