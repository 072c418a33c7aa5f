"""Words of a text as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker remembers.
REMEMBERED = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash by word (bytes), computed once for each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, by place; none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * _STEP + words[i : i + n]
    return mixed(h)
