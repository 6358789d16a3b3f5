"""Words, word hashes and shingle sets of texts, in numpy, for code that runs inside tasks.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased; both rules are the ones of
``bytes.lower().split()``. Null and empty texts have no words. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word seen, forgotten when there are too many to keep."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


#: One per Python worker: tasks that follow each other in a worker share it.
HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle at each position; fewer words than ``size`` make one shingle of all."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    total = hashes[: n - size + 1] + U64(size)
    for shift in range(1, size):
        total = total * _MULTIPLIER + hashes[shift : n - size + 1 + shift]
    return mix(total)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(HASHES.of(words_of(text)), size))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
