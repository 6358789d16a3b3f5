"""Token frequencies of documents, dictionary-encoded by block.

A task cuts its documents into blocks of a bounded number of bytes. A block numbers its distinct tokens;
each document keeps the numbers of its tokens and how often they occur, and the block keeps the tokens
themselves. Joins on tokens then move one row per block and token, not one per document and token, and
what they find comes back to the documents through the numbers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 32_000_000


def pack(codes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted numbers as differences, and their counts, each in the narrowest type that holds them."""
    order = np.argsort(codes)
    steps, counts = np.diff(codes[order], prepend=0), counts[order]
    return _narrow(steps), _narrow(counts)


def _narrow(values: np.ndarray) -> bytes:
    largest = int(values.max()) if len(values) else 0
    kind = np.uint8 if largest < 1 << 8 else np.uint16 if largest < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32}[data[0]]).astype(np.int64)


def unpack(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_widen(codes)), _widen(counts)


class _Numbers(dict):
    """Numbers tokens in the order in which they are asked for."""

    def __missing__(self, token) -> int:
        value = self[token] = len(self)
        return value


class Block:
    """Numbers of the tokens of one block."""

    def __init__(self):
        self.codes: dict = _Numbers()
        self.bytes = 0

    def add(self, tokens: Counter, size: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(tokens)
        codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, n)
        self.bytes += size
        return codes, np.fromiter(tokens.values(), np.int64, n)
