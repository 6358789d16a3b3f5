"""Connected components of a distributed edge table.

Each round, tasks first contract their edges with union-find and keep a spanning star of what they
hold; then the large-star and small-star steps (Kiveris et al., 2014) bring the stars of all tasks
together. The number of rounds grows with the logarithm of the number of nodes. No node's
neighbours are gathered in a task: both steps are aggregates and joins, which AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Edges that a task contracts at a time; bounds its memory.
BLOCK_EDGES = 200_000


def union_find(pairs) -> dict:
    """Root of each node; the root is the smallest node of its component."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def star(held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(x, root) for x, root in union_find(held).items() if x != root], columns=["u", "v"])

    held: list[tuple] = []
    for frame in frames:
        held.extend(zip(frame["u"].tolist(), frame["v"].tolist()))
        if len(held) >= BLOCK_EDGES:
            yield star(held)
            held = []
    yield star(held)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that an edge joins to another one; the root is the smallest node.

    Edges with a null end, loops and repeated edges are allowed and change nothing.
    """
    kind = edges.schema[a].dataType.simpleString()
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    stars, before = None, None
    while True:
        star = ends.mapInPandas(_contract, f"u {kind}, v {kind}").distinct()
        # large-star: neighbours larger than a node move to the smallest of its neighbourhood
        both = star.union(star.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        # small-star: the smaller neighbours of a node move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        stars = materialize(
            moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(moved.select("u", "m")).where("u <> v").distinct(), "small-star")
        # sums of hashes change as long as any edge does
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.toDF("node", "root")
        before, ends = now, stars
