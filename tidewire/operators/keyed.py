"""Set logic on keys: insert-if-absent, backlog, scored join, union, insert counts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_watchlist
from ..schemas import SCORED_COLUMNS
from ..session import local_frame

HEADLINE_KEY = ("source", "url")
ARRIVAL = ("source_rank", "rank", "seq")

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 * 1024 * 1024


def fits_broadcast(rows: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measures whether rows are few and short enough to broadcast. Runs one aggregation."""
    width = reduce(
        lambda total, name: total + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)),
        rows.columns,
        F.lit(0),
    )
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(width.cast("bigint")).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def watch_table(watch: DataFrame) -> DataFrame:
    """A watchlist kept as a table (ticker, pos) by the rule for lists: ticker, place; repeats keep their first place.

    It is broadcast only if it measures small (``fits_broadcast``); a longer one meets the rows by a shuffle.
    """
    named = watch.select(F.upper(F.trim("ticker")).alias("ticker"), F.col("pos").alias("place")).where("ticker <> ''")
    names = named.groupBy("ticker").agg(F.min("place").alias("place"))
    return F.broadcast(names) if fits_broadcast(names) else names


def first_of_key(rows: DataFrame, keys: Iterable[str] = HEADLINE_KEY, order: Iterable[str] = ARRIVAL) -> DataFrame:
    """One row per key: the first in ``order``. Rows are folded before the shuffle."""
    keys = list(keys)
    payload = [name for name in rows.columns if name not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("first"))
    return first.select(*keys, "first.*").select(*rows.columns)


def insert_if_absent(
    batch: DataFrame,
    existing: DataFrame,
    keys: Iterable[str] = HEADLINE_KEY,
    order: Iterable[str] = ARRIVAL,
    small_batch: bool = False,
) -> DataFrame:
    """Rows of the batch whose key is new; of rows with one key, the first in ``order``.

    Stored rows are never updated. Duplicates are folded before the shuffle, so a key that
    holds a large share of the batch reaches the shuffle once per task; the anti-join then
    reuses that partitioning. With ``small_batch``, the distinct keys of the batch are measured
    (``fits_broadcast``), and broadcast if few, to cut the stored keys down in place, so that a
    small increment does not shuffle the whole history. Stored tables are bucketed by
    ``headline_id``: with it as the key, the history stays in place whatever the batch's size.
    """
    keys = list(keys)
    first = first_of_key(batch, keys, order)
    known = existing.select(*keys)
    if small_batch:
        asked = batch.select(*keys).distinct()
        if fits_broadcast(asked):
            known = known.join(F.broadcast(asked), keys, "left_semi")
    return first.join(known, keys, "left_anti").select(*batch.columns)


def scoring_backlog(headlines: DataFrame, scores: DataFrame) -> DataFrame:
    """Headlines without a score."""
    return headlines.select("headline_id", "ticker", "title").join(
        scores.select("headline_id"), "headline_id", "left_anti"
    )


def scored_frame(headlines: DataFrame, scores: DataFrame, ticker: str | None = None) -> DataFrame:
    """Headlines with their scores; either side's orphans drop out."""
    if ticker:
        headlines = headlines.where(F.col("ticker") == ticker.upper())
    return headlines.join(scores, "headline_id").select(*SCORED_COLUMNS)


def union_sources(*sources: DataFrame) -> DataFrame:
    """News and forum rows in one frame, by column name; the arrival order keeps them apart."""
    return reduce(DataFrame.unionByName, sources)


def insert_counts(new: DataFrame, watch: str | Iterable[str] | DataFrame) -> DataFrame:
    """Newly stored rows per watched ticker, 0 where there are none. The watchlist may be a table (see `watch_table`)."""
    counts = new.groupBy("ticker").agg(F.count(F.lit(1)).alias("inserted"))
    if isinstance(watch, DataFrame):
        names = watch_table(watch).select("ticker")
        return names.join(counts, "ticker", "left").select("ticker", F.coalesce("inserted", F.lit(0)).alias("inserted"))
    wanted = local_frame(new.sparkSession, [(name,) for name in normal_watchlist(watch)], "ticker string")
    # the names come from an argument
    return counts.join(F.broadcast(wanted), "ticker", "right").select(
        "ticker", F.coalesce("inserted", F.lit(0)).alias("inserted")
    )
