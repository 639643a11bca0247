"""Hashes of words and of windows of words, for whole slices of texts at once.

A rolling polynomial modulo 2 ** 64 over random values per byte, from prefix sums; multipliers are odd, hence invertible.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES2 = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def rolling(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers, so that ``(sums[j] - sums[i]) * down[i]`` tells ``values[i:j]``."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return sums, down


class WordHasher:
    """The words of a slice of documents: their hashes and the document each belongs to."""

    def __init__(self, second: bool = False):
        self.letters, self.places = Powers(_ODD[0]), Powers(_ODD[1])
        self.second = WordHasher._other() if second else None

    @classmethod
    def _other(cls) -> WordHasher:
        other = cls()
        other.letters, other.places = Powers(_ODD[2]), Powers(_ODD[0])
        return other

    def words(self, texts: list[bytes], table: np.ndarray = _BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, index of its document), in order."""
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        sums, down = rolling(table[data], self.letters)
        begins = np.cumsum([1] + [len(t) + 1 for t in texts])
        docs = np.searchsorted(begins, starts, "right") - 1
        return mix((sums[ends] - sums[starts]) * down[starts]), docs

    def windows(self, hashes: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of the windows of ``k`` words that lie in one document."""
        if len(hashes) < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        sums, down = rolling(hashes, self.places)
        at = np.flatnonzero(docs[: len(docs) - k + 1] == docs[k - 1 :])
        return mix((sums[at + k] - sums[at]) * down[at]), at

    def both(self, texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two independent hashes of every window, its first word, and the document of each word."""
        hashes, docs = self.words(texts)
        first, at = self.windows(hashes, docs, k)
        again, _ = self.second.words(texts, _BYTES2)
        other, _ = self.second.windows(again, docs, k)
        return first, other, at, docs
