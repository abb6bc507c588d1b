"""Words and their hashes, taken from Arrow string columns with numpy.

A column's UTF-8 buffer is handled as one array of bytes, so no Python object is made per word. All
functions work on whole texts. Texts are handed over in slices of bounded size; a text longer than the
slice is a slice of its own.

A hash of bytes joins two polynomial sums of random byte values, modulo the prime 2**31 - 1 and at independent random bases.
Modulo a power of two such sums collide for some strings whatever the base is (Thue-Morse strings and their complements);
modulo a prime only a few bases collide for any pair. ``key`` 1 gives a second pair of sums, independent of
the first: both hashes together have 124 bits. Hashes depend on nothing but the bytes, so they agree between
tasks, executors and reruns.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_PART = 1 << 16

_PRIME = (1 << 31) - 1
_P, _31 = np.uint64(_PRIME), np.uint64(31)
_RANDOM = np.random.Generator(np.random.PCG64(20240607))


def _classes(word_bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(word_bytes)] = True
    return table


#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
BLANK_SEPARATED = _classes(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Digits, lower-case ASCII letters and every byte of a character beyond ASCII.
LETTERS_AND_DIGITS = _classes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """``data`` with A-Z in lower case; other bytes unchanged."""
    return _LOWER[data]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ np.uint64(salt)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64; grown on demand."""

    def __init__(self, base: np.uint64):
        inverse = pow(int(base), -1, 2**64)
        self.bases = np.array([base, np.uint64(inverse)], dtype=np.uint64)
        self.size, self.rows = 0, None

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 1 << 16)
            self.rows = []
            for base in self.bases:
                row = np.full(self.size, base, dtype=np.uint64)
                row[0] = 1
                self.rows.append(np.multiply.accumulate(row))
        return self.rows[0][:n], self.rows[1][:n]


_WORDS = _Powers(np.uint64(0xD1342543DE82EF95))


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x``, below 2**63, modulo the prime."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.where(x >= _P, x - _P, x)


class _Lane:
    """One polynomial modulo the prime: random values of bytes, and powers of a random base and of its inverse."""

    def __init__(self):
        self.values = _RANDOM.integers(1, _PRIME, 256, dtype=np.uint64)
        self.base = int(_RANDOM.integers(1 << 20, _PRIME - 1))
        self.inverse = pow(self.base, -1, _PRIME)
        self.kept = {self.base: np.ones(1, np.uint32), self.inverse: np.ones(1, np.uint32)}

    def _upto(self, base: int, n: int) -> np.ndarray:
        known = self.kept[base]
        while len(known) < n:
            more = _reduced(known.astype(np.uint64) * np.uint64(pow(base, len(known), _PRIME)))
            known = np.r_[known, more.astype(np.uint32)]
        if len(known) <= SLICE_BYTES:  # longer ones are for single texts and not kept
            self.kept[base] = known
        return known[:n]

    def upto(self, places: np.ndarray) -> np.ndarray:
        """The base to the power of each place."""
        return self._upto(self.base, int(places.max(initial=0)) + 1)[places]

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Sums of the terms before each byte, not reduced: terms are below 2**32, so sums of 2**31 of them are in order."""
        total, powers = np.zeros(len(data) + 1, dtype=np.uint64), self._upto(self.base, len(data))
        for a in range(0, len(data), _PART):  # small parts stay in the processor's cache
            terms = self.values[data[a : a + _PART]]
            terms *= powers[a : a + _PART]
            high = terms >> _31
            terms &= _P
            terms += high
            part = total[a + 1 : a + 1 + len(terms)]
            np.cumsum(terms, out=part)
            part += total[a]
        return total

    def moved(self, sums: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Sums as they would be ``back`` bytes nearer to the start."""
        return _reduced(_reduced(sums) * self._upto(self.inverse, int(back.max(initial=0)) + 1)[back])


_LANES = [_Lane() for _ in range(4)]


#: glibc's call that hands freed memory back; other C libraries lack it.
_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return memory that is free to the system: a worker lives on through many tasks, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the n + 1 offsets of its rows; NULL has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with about ``most`` bytes."""
    data, at = utf8(column)
    n, row = len(at) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
    if len(data) > SLICE_BYTES:
        give_back()


@dataclass
class Words:
    """Words of several texts, in order. ``first`` has each text's first word index, and the total at the end."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(data: np.ndarray, at: np.ndarray, classes: np.ndarray) -> Words:
    """Maximal runs of bytes of ``classes``, never across two texts."""
    n = len(at) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(n + 1, np.int64))
    inside = classes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, at)
    return Words(start, np.flatnonzero(ends) + 1, np.repeat(np.arange(n), np.diff(first)), first)


class Hashes:
    """64-bit hashes of any spans of ``data``; the sums over its bytes are taken once."""

    def __init__(self, data: np.ndarray, key: int = 0):
        self.lanes = [(lane, lane.sums(data)) for lane in _LANES[2 * key : 2 * key + 2]]

    @staticmethod
    def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix((first << _31) | second)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each span of bytes; equal bytes have equal hashes."""
        return self.joined(*(lane.moved(total[end] - total[start], start) for lane, total in self.lanes))

    def without(self, start: np.ndarray, cut: np.ndarray, rest: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash that ``spans`` gives the bytes from ``start`` to ``cut`` followed by those from ``rest`` to ``end``."""
        out = []
        for lane, total in self.lanes:
            # What stands behind the left-out bytes moves forward by their number.
            moved = lane.moved(total[end] - total[rest], rest - cut)
            out.append(lane.moved(_reduced(total[cut] - total[start]) + moved, start))
        return self.joined(*out)


    def edited(self, start: np.ndarray, cut: np.ndarray, byte: int, rest: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash that ``spans`` gives the bytes from ``start`` to ``cut``, then ``byte``, then those from ``rest`` to ``end``."""
        out = []
        for lane, total in self.lanes:
            own = lane.values[byte] * lane.upto(cut)
            moved = _reduced(lane.moved(total[end] - total[rest], rest - cut) * np.uint64(lane.base))
            out.append(lane.moved(_reduced(total[cut] - total[start]) + _reduced(own) + moved, start))
        return self.joined(*out)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes."""
    out = []
    for lane in _LANES[2 * key : 2 * key + 2]:  # one after the other, which takes less memory than ``Hashes``
        total = lane.sums(data)
        out.append(lane.moved(total[end] - total[start], start))
    return Hashes.joined(*out)


def hash_without(data: np.ndarray, start: np.ndarray, cut: np.ndarray, rest: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """The hash that ``hash_spans`` gives the bytes from ``start`` to ``cut`` followed by those from ``rest`` to ``end``."""
    return Hashes(data, key).without(start, cut, rest, end)


def hash_runs(words: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes, by the run's first word. For short runs (windows): the sum is
    modulo 2**64, which a special sequence of 1024 words or more would defeat."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix(words, salt) * up[:-1], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n], size)


def run_starts(words: Words, size: int) -> np.ndarray:
    """Indices of the words at which a run of ``size`` words of one text starts."""
    n = len(words.text) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.text[:n] == words.text[size - 1 :])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones of the same bits, as Spark's long has them."""
    return x.view(np.int64)
