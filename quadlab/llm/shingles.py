"""Word hashes and shingle sets of texts, computed with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers that mix the words of a shingle (splitmix64 increments).
_GOLD = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hash of each word, remembered; forgets all once it holds too many words."""

    def __init__(self, most: int = 2_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes] | pa.LargeBinaryArray) -> np.ndarray:
        if isinstance(words, pa.LargeBinaryArray):
            return _binary_hashes(words)
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: A random number for each byte, and powers of an odd base and of its inverse, as many as were needed yet.
_LETTERS = np.random.default_rng(29).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _binary_hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """64-bit hash of each word, of all bytes at once: a polynomial over the numbers of its bytes, mixed with its length."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    letters = np.frombuffer(words.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]] if len(words) else np.empty(0, dtype=np.uint8)
    ends = ends - ends[0]
    n = len(letters)
    if len(_POWERS[0]) <= n:
        _POWERS[:] = (np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(2 * n, x, dtype=np.uint64)))) for x in (_GOLD, pow(_GOLD, -1, 2**64)))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[letters] * _POWERS[0][:n])))
    return mixed((total[ends[1:]] - total[ends[:-1]]) * _POWERS[1][ends[:-1]] + np.diff(ends).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence if it is shorter; none without words."""
    n = min(size, len(h))
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(3) + h[i:len(h) - n + 1 + i] + np.uint64((_GOLD * (i + 1)) % 2**64))
    return mixed(out ^ np.uint64(n))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minimum per permutation over a non-empty set."""
    out = np.empty(len(a), dtype=np.uint64)
    for i in range(len(a)):
        x = h * a[i] + b[i]
        out[i] = (x ^ (x >> np.uint64(32))).min()
    return out
