"""Exact dedup that takes heavy hitters out of the shuffle.

1. Each row is reduced to its id and the SHA-256 of its text; only these are kept.
2. Tasks run Misra-Gries over the digests, a batch at a time, with a fixed number of counters. The summaries are merged by adding
   counters and keeping the largest. Of n rows, every digest with more than n / (counters + 1) rows is among them.
3. A second look at the digests verifies the candidates: their exact number of rows and their largest id. Those above the
   bound are the heavy hitters, at most ``counters`` of them, and are broadcast: their rows are settled map-side.
4. The other digests take an ordinary shuffle, where no group has more rows than the bound.

All but the summaries are DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Counters of a summary, and most rows of the broadcast (about 60 bytes each).
COUNTERS = 4096


class Summary:
    """Misra-Gries counters: each is at most the true count, and short of it by at most ``missed``."""

    def __init__(self, counters: int):
        self.limit, self.counts, self.missed = counters, {}, 0

    def add(self, counted) -> None:
        """Adds (digest, count) pairs, then lowers all counters until at most ``limit`` are above zero."""
        counts = self.counts
        for digest, n in counted:
            counts[digest] = counts.get(digest, 0) + n
        if len(counts) > self.limit:
            cut = sorted(counts.values(), reverse=True)[self.limit]
            self.missed += cut
            self.counts = {digest: n - cut for digest, n in counts.items() if n > cut}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(counters)
        for batch in batches:
            counted = batch.column("digest").value_counts()
            summary.add(zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(summary.counts), pa.binary()), pa.array(list(summary.counts.values()), pa.int64())], ["digest", "n"])

    return run


def _digest(normalise: Callable[[Column], Column] | None) -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.encode(normalise(text) if normalise else text, "UTF-8"), 256))


def digests(docs: DataFrame, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id, digest``: SHA-256 (32 bytes) of each row's text in UTF-8, after ``normalise``; null counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(normalise).alias("digest"))


def heavy_hitters(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest, keep_id, group_size`` of the digests with more than n / (counters + 1) of the n rows, and two at least; exact."""
    bound = max(1, rows.count() // (counters + 1))
    merged = rows.select("digest").mapInArrow(_summaries(counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    candidates = merged.orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    verified = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return verified.where(F.col("group_size") > bound)


def exact_groups(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, digest, keep_id, group_size`` of each row of ``docs`` (doc_id, text).

    Rows whose texts are equal after ``normalise`` (by SHA-256 of UTF-8; null is empty) are a group, and ``keep_id`` is its largest
    doc_id. A null doc_id is less than all others, and ``keep_id`` is null where all are. Repeated rows count each; those that repeat the
    largest doc_id have one and the same ``keep_id``. Other columns are ignored. An empty table gives no rows.
    """
    rows = materialize(digests(docs, normalise), "digests")
    heavy = materialize(heavy_hitters(rows, counters), "heavy")  # `counters` rows at most
    settled = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    return settled.select(columns).union(rest.join(groups, "digest").select(columns))


def drop_copies(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that `exact_groups` doesn't keep; all columns stay. Rows that repeat the largest doc_id of a group all stay."""
    groups = exact_groups(docs, normalise, counters)
    gone = groups.where("not doc_id <=> keep_id").select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), _digest(normalise).alias("digest"))
    kept = rows.join(gone, F.col("id").eqNullSafe(F.col("_gone_id")) & (F.col("digest") == F.col("_gone_digest")), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
