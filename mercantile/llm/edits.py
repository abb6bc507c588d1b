"""Whether two texts are one edit apart, for many pairs at once and in time linear in their lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from mercantile.llm.textkit import utf8

_AT_ONCE = 1 << 22


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's characters and the n + 1 offsets of its rows."""
    data, at = utf8(column)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return chars, before[at]


def _agreeing(left, right, start: np.ndarray, other: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """How many characters from the places on, in steps of 1 or -1, are equal before the first that differ."""
    ends = np.cumsum(size)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    row = np.repeat(np.arange(len(size)), size)
    differ = np.flatnonzero(left[start[row] + step * nth] != right[other[row] + step * nth])
    out = size.copy()
    rows, first = np.unique(row[differ], return_index=True)
    out[rows] = nth[differ[first]]
    return out


def one_edit_apart(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether exactly one inserted, deleted or replaced character makes one of the other, row by row. NULL is an empty text."""
    a, a_at = code_points(left)
    b, b_at = code_points(right)
    n, m = np.diff(a_at), np.diff(b_at)
    out = np.zeros(len(n), dtype=bool)
    rows = np.flatnonzero(np.abs(n - m) <= 1)
    size = np.minimum(n, m)
    upto = np.r_[0, np.cumsum(size[rows])]
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + _AT_ONCE, side="right")) - 1)
        own = rows[at:end]
        ahead = _agreeing(a, b, a_at[own], b_at[own], size[own], 1)
        behind = _agreeing(a, b, a_at[own + 1] - 1, b_at[own + 1] - 1, size[own], -1)
        most = np.maximum(n, m)[own]
        # Equal starts and ends cover all but one character of the longer one; equal texts agree all the way.
        out[own] = (ahead + behind >= most - 1) & ((n != m)[own] | (ahead < most))
        at = end
    return out
