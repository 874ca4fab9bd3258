"""Distinct word-shingle sets as 64-bit hashes, computed a batch of texts at a time in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

from trackloom.llm import common

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word bytes to 64-bit hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: Words whose hashes a worker keeps.
CACHE = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text, A-Z lower-cased, words split at ASCII white space.

    Fewer than ``k`` words: the whole sequence is one shingle. No word: empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    known = common.worker_state("shingles", _Words)
    if len(known) > CACHE:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n, k = max(1, len(h) - k + 1), min(k, len(h))
    x = np.full(n, np.uint64(k))
    for j in range(k):
        x = x * _ODD + h[j : j + n]
    return np.unique(mix(x))
