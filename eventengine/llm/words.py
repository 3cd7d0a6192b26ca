"""Words of a text as 64-bit hashes, and hashed word n-grams, in numpy. Small helpers that run inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
#: Words kept in a task's cache of hashes; it starts anew beyond that.
CACHE = 400_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for every run of n words; one for the whole sequence where there are fewer, none without words."""
    if not len(h):
        return h
    width = min(n, len(h))
    m = len(h) - width + 1
    acc = h[:m].copy()
    for j in range(1, width):
        acc *= _P
        acc += h[j : j + m]
    if width < n:
        acc += np.uint64(width)
    return mix(acc)
