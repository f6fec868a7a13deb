"""Word shingles of whole texts as 64-bit hashes, computed for a batch at once.

A word is a run of bytes other than space and tab to carriage return, with A-Z
lower-cased.  A shingle is ``words`` consecutive words; a text of fewer words
has one shingle, all of its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_VALUES = mix(_LOWER.astype(np.uint64) + _M3)
_SPACE = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one bound more than texts). Nulls are empty."""
    flat = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = flat.buffers()
    bounds = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of each text's first word (one bound more than texts)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    cuts = bounds[1:-1]
    cuts = cuts[cuts < n]
    begins[1:] &= ~inside[:-1]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    ends[cuts[cuts == 0] - 1] = inside[-1] if n else False
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # polynomial hash of a word as a difference of running sums, shifted back to a common origin
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[raw] * _powers(_BASE, n), out=sums[1:])
    back = _powers(_BASE_INVERSE, n)
    hashes = mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64) * _M3)
    return hashes, np.searchsorted(first, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles (not distinct) in text order, and the index of each text's first (one bound more than texts)."""
    counts = np.diff(bounds)
    shingles = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    starts = np.zeros(len(bounds), np.int64)
    np.cumsum(shingles, out=starts[1:])
    total = int(starts[-1])
    if not total:
        return np.empty(0, np.uint64), starts
    # the word at which each shingle begins
    at = np.arange(total) + np.repeat(bounds[:-1] - starts[:-1], shingles)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        out = mix(out * _M1 + padded[at + k] + np.uint64(k + 1))
    short = np.flatnonzero((counts > 0) & (counts < size))
    for t in short:
        h = np.zeros(1, np.uint64)
        for w in words[bounds[t] : bounds[t + 1]]:
            h = mix(h * _M2 + w + _M3)
        out[starts[t]] = h[0]
    return out, starts


def distinct_sets(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every text, one after the other, and their bounds."""
    parts, sizes = [], [0]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = values[a:b]
        if b - a > 1:
            own = np.sort(own)
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        parts.append(own)
        sizes.append(len(own))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(sizes)


def text_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and their bounds."""
    return distinct_sets(*shingle_hashes(*word_hashes(*text_bytes(texts)), size))
