"""Ranked lexical search, a term at a time with a limited number of accumulators.

1. Tasks turn their documents into blocks of a bounded number of bytes; a block is a row with the inverted lists of the terms that any query
   uses, and the lengths of its documents. Counts over all blocks give the weights.
2. Tasks go through the blocks. A query takes its terms in the block, rarest first, and adds each term's score to the accumulators of the documents
   in its list. The largest score of a list is known, so the terms still to come have a bound. Once a document that has none of the terms so far
   can't reach the k-th best partial score any more, no accumulators are made; those that can still reach it are updated to the end, by looking them
   up in the lists. A task keeps the best k of each query, which serve as partial scores in its next blocks.
3. The best of all tasks are ranked by a window, whose partial step drops all but k rows of a query per task.

Scores are exact integers; nothing is dropped that could be among the best k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_frame, materialize
from .frequencies import BLOCK_BYTES

#: Bytes of queries that are searched in one pass over the documents; bounds what is broadcast.
ITEM_BYTES = 8_000_000
#: Term characters are 0-9, a-z and all beyond ASCII, with A-Z lower-cased; every other byte separates.
_TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


INDEX = "block long, doc_ids array<long>, lengths array<int>, terms array<int>, dfs array<int>, docs binary, tfs binary"


def _index(vocabulary, block_bytes: int):
    names = ["block", "doc_ids", "lengths", "terms", "dfs", "docs", "tfs"]
    lists = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, number = {term: i for i, term in enumerate(vocabulary.value)}.get, TaskContext.get().partitionId() << 32
        doc_ids, lengths, keys, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            found, tfs = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)  # by term, then document
            terms, dfs = np.unique(found >> 32, return_counts=True)
            packed = [[(found & 0xFFFFFFFF).astype(np.int32).tobytes()], [tfs.astype(np.int32).tobytes()]]
            columns = [pa.array([x], kind) for x, kind in zip((doc_ids, lengths, terms, dfs), lists)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns, *[pa.array(x, pa.binary()) for x in packed]], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                keys.append(np.array([i for i in map(get, words) if i is not None], np.int64) << 32 | len(doc_ids))
                doc_ids.append(doc_id)
                lengths.append(len(words))
                size += len(text)
                if size >= block_bytes:
                    yield block()
                    doc_ids, lengths, keys, size, number = [], [], [], 0, number + 1
        if doc_ids:
            yield block()

    return run


class Block:
    """Inverted lists of a block with the score of each posting, before the weight of its term."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = np.array([0 if i is None else i for i in row["doc_ids"]], np.int64)
        self.missing = np.array([i is None for i in row["doc_ids"]])
        m = np.array([50 + 50 * length * n // total for length in row["lengths"]], np.int64)
        docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        scores = 1_000_000_000 * tfs // (1000 * tfs + 20 * m[docs])
        stops = np.cumsum(row["dfs"])
        self.lists = {t: (docs[a:b], scores[a:b], int(scores[a:b].max())) for t, a, b in zip(row["terms"], [0, *stops], stops)}


class Best:
    """The best k documents of a query so far: by score, then by doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.scores = k, np.zeros(0, np.int64)
        self.missing, self.ids = np.zeros(0, bool), np.zeros(0, np.int64)

    def floor(self, partial: np.ndarray) -> int:
        """The k-th best score together with those of ``partial``, or 1: only scores above 0 count."""
        scores = np.concatenate([self.scores, partial])
        return max(1, int(np.partition(scores, len(scores) - self.k)[len(scores) - self.k])) if len(scores) >= self.k else 1

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        at_least = self.floor(scores)
        fit = scores >= at_least
        scores, missing, ids = (np.concatenate([a, b[fit]]) for a, b in ((self.scores, scores), (self.missing, missing), (self.ids, ids)))
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.missing, self.ids = scores[order], missing[order], ids[order]


def search(block: Block, terms: list[tuple[int, int]], best: Best) -> tuple[int, int]:
    """Adds a block's documents to the ``best`` of a query with ``terms`` (term, weight), rarest first.

    Gives the number of accumulators, and the number of terms after which none were made.
    """
    lists = [(docs, w * scores, w * top) for t, w in terms if w and t in block.lists for docs, scores, top in [block.lists[t]]]
    bounds = np.array([bound for _, _, bound in lists], np.int64)
    left = [*np.cumsum(bounds[::-1])[::-1].tolist(), 0]  # what the terms from here on can add
    floor, made = best.floor(best.scores[:0]), 0
    sums = np.zeros(len(block.ids), np.int64)
    while made < len(lists) and left[made] >= floor:
        docs, scores, _ = lists[made]
        sums[docs] += scores
        made += 1
        if left[made] <= left[0] - left[made]:  # else no partial score can be above what is left
            floor = best.floor(sums[sums > 0])
    created = np.flatnonzero(sums)
    alive = created[sums[created] + left[made] >= floor]
    for docs, scores, _ in lists[made:]:
        at = np.searchsorted(docs, alive)
        at[at == len(docs)] = 0
        hit = docs[at] == alive
        sums[alive[hit]] += scores[at[hit]]
    best.add(sums[alive], block.missing[alive], block.ids[alive])
    return len(created), made


def _search(queries, k: int, n: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in queries.value]
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0], n, total)
                for terms, best in zip(queries.value, found):
                    search(block, terms, best)
        numbers = np.repeat(np.arange(len(found)), [len(b.scores) for b in found])
        scores, missing, ids = (np.concatenate([np.zeros(0, kind), *[getattr(b, c) for b in found]])
                                for c, kind in (("scores", np.int64), ("missing", bool), ("ids", np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.int64(), mask=missing), pa.array(scores)], ["number", "doc_id", "score"])

    return run


def _parts(items: DataFrame, item_bytes: int) -> Iterator[list[tuple]]:
    """The queries (id, text) in parts of bounded size, one at a time on the driver."""
    part, size = [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        part.append((row["item_id"], row["text"]))
        size += len(row["text"] or "") + 50
        if size >= item_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def _ranked(docs: DataFrame, items: list[tuple], kind: str, k: int, block_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [sorted(set(terms_of(text))) for _, text in items]
    vocabulary = sorted({t for terms in asked for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    index = materialize(docs.mapInArrow(_index(spark.sparkContext.broadcast(vocabulary), block_bytes), INDEX), "index")
    n, total = index.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    frequency = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    df = dict(frequency.toLocalIterator())  # a row for each term of the queries at most
    queries = []
    for terms in asked:
        rarest = sorted((df[number[t]], number[t]) for t in terms if number[t] in df)
        queries.append([(i, weight(n, count)) for count, i in rarest])
    found = index.mapInArrow(_search(spark.sparkContext.broadcast(queries), k, n or 0, total or 1), "number long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = local_frame(spark, [(i, item_id) for i, (item_id, _) in enumerate(items)], f"number long, item_id {kind}")
    return top.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents (doc_id, text) with the highest score above 0 for each row of ``items`` (item_id, text).

    Terms are runs of 0-9, A-Z (lower-cased), a-z and characters beyond ASCII. N documents have a term, all have L terms, a document n, and df of
    them hold a term. A document's score sums floor(1000 ln((2N + 2) / (2 df + 1))) * ((10^9 tf) div (1000 tf + 20 m)) over the distinct terms
    of the item that it holds tf times, with m = 50 + (50 n N) div L. Equal scores rank by doc_id, null last. Rows of equal
    doc_ids are documents of their own. Items are ranked row by row, also where they repeat; without terms (null, empty) they have no rows, nor has an empty
    table. Documents without terms count nowhere. Other columns are ignored. Queries are taken in parts of ``item_bytes``, each a pass over the documents.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    parts = [_ranked(texts, part, kind, k, block_bytes) for part in _parts(items, item_bytes)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result
