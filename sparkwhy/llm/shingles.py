"""Words, shingles and MinHash signatures as numpy arrays.

Everything here is a pure function of one text or one batch of texts, so a
lost task can be repeated anywhere with the same result.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
# Fixed odd multipliers that combine word hashes into shingle hashes.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)
_EMPTY = np.empty(0, _U)


class WordHashes(dict):
    """64-bit hash of each word seen; forgets everything beyond ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D; only A-Z are lower-cased."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hash_words(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), _U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in order; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return _EMPTY
    out = np.zeros(n, _U)
    for k in range(width):
        out += hashes[k : k + n] * _U(_MIX[k % len(_MIX)] + 2 * (k // len(_MIX)))
    return mix(out)


def shingle_set(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` make one shingle."""
    words = words_of(text)
    if not words:
        return _EMPTY
    hashes = hash_words(words, cache)
    if len(words) < width:
        return windows(hashes, len(words)) ^ _U(len(words))
    return np.unique(windows(hashes, width))


class MinHasher:
    """``n`` 32-bit MinHash values of each set in a batch."""

    def __init__(self, n: int, seed: int = 20_11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.n = n

    def __call__(self, sets: list[np.ndarray], block: int = 32_768) -> np.ndarray:
        """One row per set; a set without members gets the largest value everywhere."""
        out = np.full((len(sets), self.n), 0xFFFFFFFF, np.uint32)
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= block):
                size += len(sets[end])
                end += 1
            rows = [i for i in range(at, end) if len(sets[i])]
            at = end
            if not rows:
                continue
            flat = np.concatenate([sets[i] for i in rows])
            starts = np.cumsum([0] + [len(sets[i]) for i in rows[:-1]])
            buffer = np.empty_like(flat)
            for k in range(self.n):
                np.multiply(flat, self.a[k], out=buffer)
                buffer += self.b[k]
                out[rows, k] = np.minimum.reduceat(buffer, starts) >> _U(32)
        return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
