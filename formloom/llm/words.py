"""Words of texts as 64-bit hashes, computed in numpy on the UTF-8 bytes of Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the pattern ``[^\\x20\\x09-\\x0D]+`` on
characters, since those bytes never occur inside a multi-byte UTF-8 character. Two words count as equal when their
64-bit hashes are (two given words collide with a chance of about 2**-60).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text makes a slice of its own, hashed in parts of this size.
SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    up = down = np.ones(1, U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, SLICE_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            up, down = np.full(n, _BASE, U), np.full(n, inverse, U)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up, cls.down


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) of runs of texts of about `most` bytes.

    A null text counts as an empty one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case; all others stay."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words begin among them (rows + 1 numbers).

    gap: for each of the 256 bytes, whether it stands between words.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = gap[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    return starts, np.flatnonzero(~space & after) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word data[start:end]."""
    out = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = data[base : ends[hi - 1]]
        up, down = _Powers.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        lo = hi
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, in order; len(words) - n + 1 numbers."""
    if len(words) < n:
        return np.zeros(0, U)
    out = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        out = out * U(_BASE) + words[k : len(words) - n + 1 + k]
    return mix(out)


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word the row that it belongs to; first as spans() gives it."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
