"""Vectorised text kernels over Arrow string columns: spans of words, 64-bit span hashes, segment helpers.

All functions work on the UTF-8 bytes of whole texts. Blocks of rows are cut so that a block holds about BLOCK bytes; a
single longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit value a byte; capital letters A-Z share that of their small letter.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

#: Bytes of words: digits, letters and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: Bytes of tokens that white space ends: all but space and \x09 to \x0D.
SOLID_BYTES = np.ones(256, bool)
SOLID_BYTES[9:14] = SOLID_BYTES[32] = False

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers = made[0], made[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        column, wide = column.cast(pa.string()), np.int32
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the bytes in `members`, never across rows: starts, ends, and the first run of each row."""
    inside = members[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets, side="left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span stands."""
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def window_hashes(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive items of each row; a shorter row that isn't empty is one window.

    first: where each row's items begin, and the end. Returns the hashes and where each row's begin, and the end.
    """
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=begin[1:])
    rows = np.repeat(np.arange(len(made)), made)
    at = np.arange(begin[-1]) - begin[rows] + first[rows]
    reach = np.minimum(size, counts[rows])
    out = np.zeros(len(at), np.uint64)
    multiplier = np.uint64(0xA0761D6478BD642F)
    for j in range(size):
        here = j < reach
        got = h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(here, (out ^ got) * multiplier + np.uint64(j + 1), out)
    return mix(out), begin


def segment_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum of each segment, 0 for an empty one."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[begin[1:]] - sums[begin[:-1]]
