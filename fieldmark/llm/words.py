"""Words and word shingles: small helpers for use inside tasks.

A word is a run of characters other than U+0020 and U+0009 to U+000D.  In
UTF-8 this is what ``bytes.split()`` yields, so words stay bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

ASCII_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def lower_words(text: str | None) -> list[bytes]:
    """Words after A-Z are lower-cased; none for a null text."""
    return text.encode().translate(ASCII_LOWER).split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash, computed once for each distinct word; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of ``width`` words; fewer words make one window; no words, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        total = mixed(total * _MIX[0] + hashes[j : n - k + 1 + j])
    return total
