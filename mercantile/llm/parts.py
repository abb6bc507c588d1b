"""Texts cut into parts that a byte-level tokenizer encodes on their own, and a bounded memory of the parts' ids.

Such a tokenizer cuts a text into words before encoding it. Some of its cuts can be told from the neighbouring characters alone:

* before a blank that stands between two characters other than white space,
* on both sides of another white-space character that stands so,
* between ASCII letters, digits and other visible ASCII characters, but for the place after an apostrophe.

What stands on one side of such a place has no say in how the other side is cut. So the parts between these places are encoded
on their own, with the same ids as within the whole text; a part may hold several words. Where two or three bytes leave open
what a character is, and within strings of added tokens, no cut is made.

A column is handled as one array of bytes. Parts are told apart by Arrow's dictionary encoding, so Python sees each distinct part
of a slice once; ids are gathered with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from mercantile.llm.textkit import slices

SLICE_BYTES = 4 << 20
#: Parts and ids that are remembered, and the bytes of the longest part that is.
MOST_PARTS, MOST_IDS, LONGEST = 800_000, 4_000_000, 64

#: ASCII white space, also the separators that some libraries count as such.
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
#: ASCII letters, digits and other visible characters; 0 for all other bytes.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KINDS = _KIND.tobytes()


def _white_after(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether a character that begins with these two bytes may be white space."""
    two = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
    three = ((first == 0xE1) & (second == 0x9A)) | ((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80))
    return _WHITE[first] | two | three


def _lone(data: np.ndarray, white: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Those places of white space that stand within a text, between characters other than white space."""
    white = white[~edge[white] & ~edge[white + 1]]
    last = len(data) - 1
    first, second = data[white + 1], data[np.minimum(white + 2, last)]
    one, two, three = data[white - 1], data[np.maximum(white - 2, 0)], data[np.maximum(white - 3, 0)]
    before = _WHITE[one] | ((one >= 0x80) & (_white_after(two, one) | ((three >= 0xE1) & _white_after(three, two))))
    return white[~before & ~_white_after(first, second)]


class Added(NamedTuple):
    """Strings of added tokens, and what finds them in bytes, also overlapping ones; the longest at a place."""

    strings: list[bytes]
    pattern: re.Pattern

    def within(self, raw: bytes) -> Iterator[re.Match]:
        # Most texts have none, which a plain search tells much faster than a pattern that tries every place.
        return self.pattern.finditer(raw) if any(t in raw for t in self.strings) else iter(())


def cut_places(data: np.ndarray, at: np.ndarray, added: Added | None = None) -> np.ndarray:
    """Places before which texts may be cut, other than their own begin. ``added`` finds strings that stay whole."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    raw = data.tobytes()
    kind = np.frombuffer(raw.translate(_KINDS), dtype=np.uint8)
    between = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != 0x27)) + 1
    feeds = _lone(data, np.flatnonzero((data >= 9) & (data <= 13)), edge)
    places = np.concatenate([between[~edge[between]], _lone(data, np.flatnonzero(data == 32), edge), feeds, feeds + 1])
    if added is not None:
        inside = np.zeros(len(data) + 1, dtype=bool)
        for found in added.within(raw):
            # An overlapping look-ahead: each string is the group, also where another one began before.
            inside[found.start() + 1 : found.end(1)] = True
        places = places[~inside[places]]
    return places


def cut(data: np.ndarray, at: np.ndarray, added: Added | None = None, whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts in order, as binary, and the number of each text's first part (their total at the end)."""
    starts = at[:-1][np.diff(at) > 0]
    if not whole and len(data):
        begins = np.zeros(len(data), dtype=bool)
        begins[starts] = begins[cut_places(data, at, added)] = True
        starts = np.flatnonzero(begins)
    offsets = np.r_[starts, len(data)].astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return parts, np.searchsorted(starts, at)


def pattern_of(added: Sequence[str]) -> Added | None:
    """What finds the strings of added tokens; None if there are none."""
    longest = sorted((t.encode() for t in added), key=len, reverse=True)
    return Added(longest, re.compile(b"(?=(" + b"|".join(map(re.escape, longest)) + b"))")) if longest else None


class PartIds:
    """Ids of texts from those of their parts. ``encode`` takes distinct parts and gives all ids, and each part's number of them."""

    def __init__(self, encode: Callable[[Sequence[bytes]], tuple[np.ndarray, np.ndarray]], added: Sequence[str] = (), whole: bool = False):
        self.encode, self.added, self.whole = encode, pattern_of(added), whole
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _places(self, parts: list[bytes]) -> np.ndarray:
        """Where each of these distinct parts is in the memory; new ones are encoded together."""
        if len(self.begin) > MOST_PARTS or len(self.flat) > MOST_IDS:
            self._forget()
        place = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        absent = np.flatnonzero(place < 0)
        if len(absent):
            new = [parts[k] for k in absent.tolist()]
            ids, sizes = self.encode(new)
            own = np.arange(len(self.begin), len(self.begin) + len(new))
            place[absent] = own
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size, self.flat = np.concatenate([self.size, sizes]), np.concatenate([self.flat, ids])
            self.known.update((p, k) for p, k in zip(new, own.tolist(), strict=True) if len(p) <= LONGEST)
        return place

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, all ids, where each row's ids begin, and their end) for slices of a column."""
        for first, end, data, at in slices(column, SLICE_BYTES):
            parts, bounds = cut(data, at, self.added, self.whole)
            found = parts.dictionary_encode()
            place = self._places(found.dictionary.to_numpy(zero_copy_only=False).tolist())[found.indices.to_numpy(zero_copy_only=False)]
            sizes = self.size[place]
            ends = np.r_[0, np.cumsum(sizes)]
            spots = np.repeat(self.begin[place] - ends[:-1], sizes)
            spots += np.arange(ends[-1])
            yield first, end, self.flat[spots], ends[bounds]
