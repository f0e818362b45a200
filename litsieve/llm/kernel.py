"""Vectorised byte kernels over Arrow columns: words, word hashes and shingles, many documents at a time.

All functions work on whole texts. Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; other bytes stay as they are.
A word's hash is a polynomial over its bytes modulo 2**64, taken from one running sum per segment, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEGMENT = 1 << 19

_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACES = np.random.default_rng(7).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all of them."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def parts(column: pa.Array, max_bytes: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) of a binary column with their joined bytes and offsets (from 0), about max_bytes at a time."""
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document boundary the number of words before it."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inner = ~SEPARATORS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inner.copy()
    first[1:] &= ~inner[:-1] | edge[1:n]
    last = inner
    last[:-1] &= ~last[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span; spans must be sorted. Works in segments, so memory doesn't grow with the text."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        at = starts[k]
        m = max(k + 1, int(np.searchsorted(ends, at + SEGMENT, "right")))
        piece = data[at : ends[m - 1]]
        codes = _BYTE_CODES[LOWER[piece] if lower else piece]
        up, down = _powers(len(piece) + 1)
        codes *= up[: len(piece)]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(codes, out=total[1:])
        s, e = starts[k:m] - at, ends[k:m] - at
        out[k:m] = mix((total[e] - total[s]) * down[s])
        k = m
    return out


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring word hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:m] * _PLACES[0]
    for i in range(1, n):
        total = total + hashes[i : i + m] * _PLACES[i]
    return mix(total)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles.

    With fewer than n words the whole sequence counts as one shingle, set apart from n-word ones; without words the set
    is empty.
    """
    for i, j, data, offsets in parts(column):
        starts, ends, first = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends)
        runs = window_hashes(hashes, n)
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            elif b > a:
                short = (hashes[a:b] * _PLACES[8 : 8 + b - a]).sum(keepdims=True, dtype=np.uint64)
                yield mix(short + np.uint64(0xABCDEF12345 + b - a))
            else:
                yield np.zeros(0, np.uint64)
