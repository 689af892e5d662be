"""Words and word hashes of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Texts are handled in blocks of about BLOCK bytes (a longer text is a block of its own), so that memory
does not grow with the batch. A word's hash is a polynomial over its bytes modulo 2**64, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of anything but ASCII white space.
BLANK_DELIMITED = np.ones(256, dtype=bool)
BLANK_DELIMITED[[9, 10, 11, 12, 13, 32]] = False

#: Words of ASCII letters and digits and of all that is not ASCII.
ALNUM_DELIMITED = np.zeros(256, dtype=bool)
ALNUM_DELIMITED[48:58] = ALNUM_DELIMITED[65:91] = ALNUM_DELIMITED[97:123] = ALNUM_DELIMITED[128:] = True


class Block(NamedTuple):
    """Texts first..last-1 of a batch: bounds[i]..bounds[i+1] are the words of text first+i; starts and ends are bytes."""

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK, 1 << (n - 1).bit_length())
    if size not in _powers:
        if size > 4 * BLOCK:
            _powers.clear()
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers[size] = (out[0], out[1])
    return _powers[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return offsets, raw


def blocks(column: pa.Array, word_bytes: np.ndarray) -> Iterator[Block]:
    """The blocks of a string column, with hashes of the words in lower case (A-Z only)."""
    offsets, raw = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
        yield _block(first, offsets[first : last + 1] - offsets[first], raw[offsets[first] : offsets[last]], word_bytes)
        first = last


def _block(first: int, offsets: np.ndarray, raw: np.ndarray, word_bytes: np.ndarray) -> Block:
    inside = word_bytes[raw]
    if not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return Block(first, np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.uint64), offsets, none, none)
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = _powers_of(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return Block(first, np.searchsorted(starts, offsets), hashes, offsets, starts, ends)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, factor = np.zeros(n, dtype=np.uint64), _BASE
    for j in range(k):
        total += hashes[j : j + n] * np.uint64(factor)
        factor = (factor * _BASE + 2 * j) & 0xFFFFFFFFFFFFFFFF | 1
    return mix(total)
