"""Word hashing shared by the shingle operators (numpy, one pass over whole texts)."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words that a task remembers (of LONGEST bytes at most, some 16 MB in all); beyond it the memory starts anew,
#: results do not change.
MEMORY_WORDS, LONGEST = 80_000, 64
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word bytes -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks, tabs and line ends after lower-casing A-Z; no others for null or blank texts."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width`-word shingles; shorter sequences are one shingle; no words, none."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(width, n)
    out = np.full(n - size + 1, mix(np.array([size], np.uint64))[0], np.uint64)
    for k in range(size):
        out = mix(out + hashes[k : n - size + 1 + k] + _GOLDEN)
    return np.unique(out)
