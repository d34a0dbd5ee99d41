"""Hashes of words and of their runs, in NumPy."""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def seeded(seed: int) -> np.uint64:
    return np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """Word to 64-bit hash, remembered; emptied when it holds too many."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most
        import xxhash

        self.of = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.of(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lowered_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case: runs of anything but space and U+0009 to U+000D."""
    return bytes(text).lower().split() if text else []


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for every k words in a row; of fewer words, one for all of them."""
    k = min(k, len(h))
    n = len(h) - k + 1
    if not k:
        return h[:0]
    acc = np.full(n, seeded(k), np.uint64)
    for j in range(k):
        acc = mix((acc + h[j : j + n]) * _A)
    return acc
