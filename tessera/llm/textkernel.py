"""Vectorised word scanning over the bytes of an Arrow string column.

A word is a maximal run of the bytes of a class. Words get 64-bit hashes from prefix sums of
byte * BASE**position (mod 2**64), so that any substring's hash is a difference of two sums.
Bytes of 0x80 and above all belong to the classes used, so no character is ever cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


POW = _powers(_BASE)
INV = _powers(pow(_BASE, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words divided by white space (0x20 and 0x09 to 0x0D).
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of digits, a-z (after lower-casing) and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows in them); a null is an empty text."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and each word's row; no word crosses a row's end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = lut[data]
    edge = np.zeros(len(data), dtype=bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:] & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def _long_hash(v: np.ndarray) -> int:
    """The hash of a word longer than a segment, block by block."""
    total, scale, step = 0, 1, pow(_BASE, SEGMENT, 1 << 64)
    for i in range(0, len(v), SEGMENT):
        block = v[i : i + SEGMENT].astype(np.uint64) + np.uint64(1)
        total = (total + int(np.sum(block * POW[: len(block)], dtype=np.uint64)) * scale) & _MASK
        scale = scale * step & _MASK
    return total


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = (), suffixes: tuple[int, ...] = ()
) -> list[np.ndarray]:
    """Hashes of the lower-cased words, then of their first and last bytes (whole words where shorter)."""
    n = len(starts)
    parts = 1 + len(prefixes) + len(suffixes)
    out = [np.empty(n, np.uint64) for _ in range(parts)]
    i = 0
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + SEGMENT, side="right"))
        if j <= i:
            word = LOWER[data[starts[i] : ends[i]]]
            out[0][i] = _long_hash(word)
            for k, p in enumerate(prefixes):
                out[1 + k][i] = _long_hash(word[:p])
            for k, s in enumerate(suffixes):
                out[1 + len(prefixes) + k][i] = _long_hash(word[-s:])
            i += 1
            continue
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((LOWER[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * POW[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        at, inv = sums[s], INV[s]
        out[0][i:j] = (sums[e] - at) * inv
        for k, p in enumerate(prefixes):
            out[1 + k][i:j] = (sums[np.minimum(s + p, e)] - at) * inv
        for k, p in enumerate(suffixes):
            b = np.maximum(e - p, s)
            out[1 + len(prefixes) + k][i:j] = (sums[e] - sums[b]) * INV[b]
        i = j
    return [mix(h) for h in out]
