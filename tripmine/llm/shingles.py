"""Hashed word shingles of whole texts, with numpy, for use inside tasks.

Words are runs of bytes other than space and 09-0D after A-Z is lower-cased.
A text of fewer than ``k`` words has its whole word sequence as one shingle; a
null or blank text has none. Shingles are 64-bit hashes, distinct and sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240501).integers(0, 1 << 64, 256, np.uint64)
_LETTERS[65:91] = _LETTERS[97:123]
_PLACES = np.random.default_rng(20240502).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, np.uint64(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], ~_BLANK[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64)
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _power(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingles of ``k`` words."""
    words = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mixed(np.array([(words * _PLACES[:n]).sum(dtype=np.uint64)]) + np.uint64(n))
    total = words[: n - k + 1] * _PLACES[0]
    for j in range(1, k):
        total = total + words[j : n - k + 1 + j] * _PLACES[j]
    return np.unique(mixed(total + np.uint64(k)))


def rows_of(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none holds much more than ``chars`` bytes."""
    for batch in batches:
        step = max(1, int(batch.num_rows * chars / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
