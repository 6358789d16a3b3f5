"""Uniform random shuffle into shards of exact sizes, by a hypergeometric communication matrix.

A uniform permutation of all rows sends a multivariate hypergeometric number of each part's rows to each
shard. So the matrix of these numbers is drawn first (parts x shards, exact totals on both sides); then each
part permutes its rows and deals them out by its row of the matrix, the rows are exchanged, and each shard permutes what it got.

Permutations are sorts by a hash of seed and row number, so that a task that runs again deals the same
rows; the row numbers are written to the shared folder first. Parts are at most ``MAX_PARTS`` groups
of input partitions, which bounds the matrix, the only thing that the driver holds. Shards are sorted in ``strips`` of
hash ranges, so that few shards don't mean few tasks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_frame, materialize

MAX_PARTS = 4096
STRIPS = 64
#: Above this, numpy's sampler refuses.
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` of good + bad, also for populations beyond numpy's limit."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    mean = drawn * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - drawn) / max(total - 1, 1))) + 1
    # inverse of the distribution over 40 deviations, by ratios of neighbours from the lowest value
    first, last = max(low, int(mean - 20 * spread)), min(high, int(mean + 20 * spread))
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows that go from each part to each shard; sums are the given sizes on both sides."""
    rng = np.random.default_rng(seed)
    left = list(shards)
    matrix = np.zeros((len(parts), len(shards)), np.int64)
    for part, size in enumerate(parts):
        rest, room = size, sum(left)
        for shard in range(len(shards)):
            room -= left[shard]
            matrix[part, shard] = hypergeometric(rng, left[shard], room, rest)
            rest -= matrix[part, shard]
        for shard in range(len(shards)):
            left[shard] -= int(matrix[part, shard])
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def uniform_shards(rows: DataFrame, shards: int, seed: int = 7, max_parts: int = MAX_PARTS, strips: int = STRIPS) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (long, from 0, gapless in each shard).

    Counts of shards are at most one apart; which rows get where is a uniform permutation. Columns, nulls and
    repeated rows don't matter: rows are told apart by a number given when they're written. Columns of ``rows`` that are
    named like those added are kept under their name with an underscore in front. An empty table gives none.
    """
    numbered = materialize(rows.select(
        F.struct(*rows.columns).alias("row"), (F.spark_partition_id() % max_parts).alias("_part"), F.monotonically_increasing_id().alias("_number")), "numbered")
    counts = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shard_sizes(sum(counts.values()), shards), seed)
    ends = np.cumsum(matrix, axis=1)
    table = local_frame(rows.sparkSession, [(p, ends[i].tolist()) for i, p in enumerate(parts)], "_part int, _ends array<bigint>")

    def order(salt: int):
        return [F.xxhash64(F.lit(seed), F.lit(salt), "_number"), F.col("_number")]

    # the matrix has max_parts x shards numbers at most
    local = numbered.join(F.broadcast(table), "_part").withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order(1))))
    dealt = local.withColumn("shard", F.size(F.filter("_ends", lambda end: end < F.col("_rank")))).drop("_ends", "_rank", "_part")
    # the second permutation sorts by a hash; its range is cut into strips, each a sort of its own
    strip = F.shiftrightunsigned(order(2)[0], 40) * strips / (1 << 24)
    dealt = materialize(dealt.withColumn("_strip", strip.cast("int")), "dealt")
    sizes = dealt.groupBy("shard", "_strip").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_strip", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    at = F.row_number().over(Window.partitionBy("shard", "_strip").orderBy(*order(2)))
    # shards x strips rows
    placed = dealt.join(F.broadcast(offsets), ["shard", "_strip"]).withColumn("slot", (F.col("_offset") + at - 1).cast("long"))
    own = [F.col(f"row.`{c}`").alias(f"_{c}" if c.lower() in ("shard", "slot") else c) for c in rows.columns]
    return placed.select(*own, "shard", "slot")
