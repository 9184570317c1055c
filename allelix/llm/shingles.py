"""Word shingles of whole texts as sorted sets of 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct
hashes of all runs of ``n`` words; with fewer words, the whole sequence is
one shingle; without words the set is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

# hashes of words that a Python worker keeps during a task
CACHE_WORDS = 200_000


class _Words(dict):
    """word -> 64-bit hash, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Words()


def release() -> None:
    """Give back what a task kept, at its end: an idle worker holds no words and no Arrow buffers."""
    _HASHES.clear()
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes (bytes.lower and bytes.split know ASCII only)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(n, len(w))
    rows = len(w) - n + 1
    acc = np.full(rows, n, np.uint64)
    for k in range(n):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + w[k:k + rows])
    return np.unique(acc)
