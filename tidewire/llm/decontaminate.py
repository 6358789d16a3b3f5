"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document, as many words long as a benchmark item, gets a 64-bit SimHash of its words. Items
within ``RADIUS`` bits are found by multi-index hashing: the fingerprint is cut into RADIUS + 1 blocks, and two
fingerprints within the radius agree in one block at least, so that looking up each block finds all of
them. Candidates are verified by the exact weighted Jaccard similarity of their word shingles
(weight: number of occurrences).

A window whose similarity is at least t has 2t / (1 + t) of its shingles in common with an item of its
length. Windows with fewer shingles of any item are therefore not fingerprinted; that loses nothing.

A document with fewer words than an item is the one window for it. As the SimHash of a shorter window is further off, such
a document isn't fingerprinted: each longer item that shares a shingle with it is compared exactly, where the
numbers of shingles allow the threshold.

The benchmark is taken in blocks of a bounded number of bytes, one pass over the documents for each
block; its index is broadcast. Documents aren't shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import HASHES, U64, mix, shingle_hashes, words_of

#: A pair at the default threshold differs in one word of 45 or more: 5 bits in the mean, 2.1 deviation.
RADIUS = 12
#: Bytes of benchmark texts in a block (a longer item is a block of its own).
BLOCK_BYTES = 8_000_000
_FILTER_BITS = 22


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each the majority of that bit over the words."""
    bits = np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(U64)[0])


def block_masks(radius: int = RADIUS) -> list[int]:
    """radius + 1 disjoint masks that cover 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(cuts, cuts[1:])]


def similarity(a: Counter, b: Counter) -> float:
    """Sum of least weights over sum of largest."""
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared) if shared else 0.0


class ItemIndex:
    """Items of one block of the benchmark, by length and by blocks of the fingerprint."""

    def __init__(self, items: list[tuple[int, str]], size: int, threshold: float):
        self.size, self.threshold, self.masks = size, threshold, block_masks()
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        self.items: list[tuple[int, int, Counter]] = []  # id, fingerprint, shingles
        found = []
        for item_id, text in items:
            hashes = HASHES.of(words_of(text))
            if not len(hashes):
                continue
            shingles = shingle_hashes(hashes, size)
            found.append(shingles)
            print_ = simhash(hashes)
            tables = self.tables.setdefault(len(hashes), [defaultdict(list) for _ in self.masks])
            for table, mask in zip(tables, self.masks):
                table[print_ & mask].append(len(self.items))
            self.items.append((item_id, print_, Counter(shingles.tolist())))
        every = np.concatenate(found) if found else np.zeros(0, U64)
        order = np.argsort(every, kind="stable")
        #: Each occurrence of a shingle, sorted, and the item that it is in.
        self.every, self.owners = every[order], np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])[order]
        self.shingles = np.unique(every)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.shingles >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def known(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles an item holds."""
        maybe = self.filter[(shingles >> U64(64 - _FILTER_BITS)).astype(np.int64)]
        at = np.flatnonzero(maybe)
        place = np.searchsorted(self.shingles, shingles[at])
        maybe[at] = self.shingles[np.minimum(place, len(self.shingles) - 1)] == shingles[at]
        return maybe

    def within_radius(self, print_: int, length: int) -> set[int]:
        near = set()
        for table, mask in zip(self.tables[length], self.masks):
            for item in table.get(print_ & mask, ()):
                if (self.items[item][1] ^ print_).bit_count() <= RADIUS:
                    near.add(item)
        return near

    def longer(self, shingles: np.ndarray) -> Iterator[tuple[int, float]]:
        """Items with more shingles than a whole document, and similarities of at least the threshold."""
        n = len(shingles)
        low, high = np.searchsorted(self.every, np.unique(shingles)), np.searchsorted(self.every, np.unique(shingles), "right")
        weights = None
        for item in np.unique(np.concatenate([self.owners[a:b] for a, b in zip(low, high)])).tolist():
            theirs = self.items[item][2]
            if n < theirs.total() <= n / self.threshold + 1e-9:
                weights = weights or Counter(shingles.tolist())
                score = similarity(weights, theirs)
                if score >= self.threshold - 1e-9:
                    yield item, score

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """Item, first word, words and similarity: the best window (leftmost of ties) for each item."""
        hashes = HASHES.of(words_of(text))
        best: dict[int, tuple[float, int, int]] = {}
        if not len(hashes) or not self.items:
            return []
        long = shingle_hashes(hashes, self.size) if len(hashes) >= self.size else hashes[:0]
        hits = self.known(long) if len(long) else np.zeros(0, bool)
        total = np.concatenate([[0], np.cumsum(hits)])
        shorter = [n for n in self.tables if n < self.size]
        if not shorter and not total[-1]:
            return []
        need = 2 * self.threshold / (1 + self.threshold)
        for length in self.tables:
            if length > len(hashes):  # below
                continue
            if length < self.size:  # its one shingle is all its words
                windows = shingle_hashes(hashes, length)
                starts = np.flatnonzero(self.known(windows))
            else:
                n = length - self.size + 1
                starts = np.flatnonzero(total[n:] - total[:-n] >= need * n - 1e-9)
            done: dict[bytes, set[int]] = {}
            for start in starts.tolist():
                own = hashes[start : start + length]
                key = own.tobytes()
                if key in done:  # a repeated passage: the leftmost counts
                    continue
                done[key] = near = self.within_radius(simhash(own), length)
                if near:
                    weights = Counter(shingle_hashes(own, self.size).tolist())
                for item in near:
                    score = similarity(weights, self.items[item][2])
                    if score >= self.threshold - 1e-9:
                        best[item] = max(best.get(item, (0.0, 0, 0)), (score, -start, length))
        # of n shingles and more than n of the item, t / (1 + t) of both together are in common
        if len(long) and total[-1] >= need * len(long) - 1e-9:
            best.update((item, (score, 0, len(hashes))) for item, score in self.longer(long))
        return [(self.items[item][0], -start, length, score) for item, (score, start, length) in best.items()]


def _finding(index):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            rows = [(doc_id, hash_, *match)
                    for doc_id, hash_, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hash", "text")))
                    for match in items.matches(text)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "hash", "item_id", "start", "words", "similarity"])

    return find


def _blocks(items: Iterator, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    held, total = [], 0
    for item_id, text in items:
        if held and total + len(text) > block_bytes:
            yield held
            held, total = [], 0
        held.append((item_id, text))
        total += len(text)
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, hash, item_id, start, words, similarity`` of each row of ``docs`` and item found in it.

    ``start`` and ``words`` give the best window (in words; the leftmost of ties): as long as the item, or the
    whole document if it has fewer words than the item. Words are lower-cased (A-Z)
    runs without white space. Null, empty and blank texts hold nothing and are found nowhere; null
    item_ids are kept as null. Items under ``size`` words are compared whole. Repeated rows are found each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = None
    for block in _blocks(items.toLocalIterator(), block_bytes):
        index = spark.sparkContext.broadcast(ItemIndex(block, size, threshold))
        part = texts.mapInArrow(_finding(index), "doc_id long, hash long, item_id long, start int, words int, similarity double")
        part = materialize(part, "leaks")
        index.unpersist()
        found = part if found is None else found.union(part)
    if found is None:
        found = texts.mapInArrow(lambda batches: iter(()), "doc_id long, hash long, item_id long, start int, words int, similarity double")
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all their columns."""
    leaks = contaminated(docs, benchmark, size, threshold).select("doc_id", "hash").distinct().toDF("bad_id", "bad_hash")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    on = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash"))
    return rows.join(leaks, on, "left_anti").select("row.*")
