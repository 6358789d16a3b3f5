"""Forward returns over a calendar that all tickers share.

The work is long and keyed by ticker: one shuffle of the closes by ticker serves the grid, the
fill, the return and the lead.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def _by_ticker():
    return W.partitionBy("ticker").orderBy("date")


def calendar_grid(prices: DataFrame) -> DataFrame:
    """Closes on every day that any ticker has a row for: date, ticker, close (NULL in gaps).

    ``prices`` has one row per (date, ticker). The days are numbered, and each row is stretched over the
    numbers up to the ticker's next row: no product of days and tickers is joined, and a stray date adds one
    day. The day list may be broadcast whatever the data: a DATE column has at most 3.7 million values (a
    century of trading has 25,000).
    """
    days = prices.select("date").distinct().select("date", F.row_number().over(W.orderBy("date")).alias("number"))
    last_number = days.agg(F.max("number").alias("number")).scalar()
    numbered = prices.join(F.broadcast(days), "date")
    spans = numbered.select(
        "ticker",
        "number",
        "close",
        F.when(F.lag("number").over(_by_ticker()).isNull(), 1).otherwise(F.col("number")).alias("from"),
        F.coalesce(F.lead("number").over(_by_ticker()) - 1, last_number).alias("to"),
    )
    cells = spans.select("ticker", "number", "close", F.explode(F.sequence("from", "to")).alias("day"))
    cells = cells.select(
        F.col("day").alias("number"),
        "ticker",
        F.when(F.col("day") == F.col("number"), F.col("close")).alias("close"),
    )
    return cells.join(F.broadcast(days), "number").select("date", "ticker", "close")


def drop_empty_dates(returns: DataFrame) -> DataFrame:
    """Removes a day when every ticker's return is NULL on it."""
    days = returns.where("ret is not null").select("date").distinct()
    return returns.join(F.broadcast(days), "date", "left_semi").select(*returns.columns)


def returns(prices: DataFrame, fill: str | None = "pad") -> DataFrame:
    """Close-to-close returns on the shared calendar: date, ticker, ret.

    ``fill="pad"`` carries the last close over gaps first, so a gap day returns 0; ``None``
    leaves gaps. A previous close of 0 gives NULL. Days without any return are dropped.
    """
    grid = calendar_grid(prices)
    if fill == "pad":
        so_far = _by_ticker().rowsBetween(W.unboundedPreceding, W.currentRow)
        grid = grid.withColumn("close", F.last("close", ignorenulls=True).over(so_far))
    elif fill is not None:
        raise ValueError(f"fill must be 'pad' or None, not {fill!r}")
    ret = F.try_divide("close", F.lag("close").over(_by_ticker())) - 1
    return drop_empty_dates(grid.select("date", "ticker", ret.alias("ret")))


def forward_returns(returns: DataFrame) -> DataFrame:
    """The next calendar row's return on today's row: date, ticker, fwd_ret."""
    return returns.select("date", "ticker", F.lead("ret").over(_by_ticker()).alias("fwd_ret"))


def _days_with_returns(days: DataFrame, closes: DataFrame, fill: str | None) -> DataFrame:
    """The numbered days (date, number) on which any ticker has a return, from closes (ticker, number, close)."""
    by_number = W.partitionBy("ticker").orderBy("number")
    if fill is None:
        before = F.when(F.lag("number").over(by_number) == F.col("number") - 1, F.lag("close").over(by_number))
        found = closes.withColumn("before", before).where("close is not null and before <> 0").select("number").distinct()
        return days.join(F.broadcast(found), "number", "left_semi")
    # A close that is no 0 gives a return on each day from the next one to the ticker's next close. These intervals
    # are added up as steps: one row for each day that one begins or ends on, however many closes there are.
    spans = closes.where("close is not null").select(
        "close", (F.col("number") + 1).alias("from"), (F.lead("number").over(by_number) + 1).alias("after")
    ).where("close <> 0")
    steps = spans.groupBy(F.col("from").alias("number")).agg(F.count("*").alias("step")).unionByName(
        spans.where("after is not null").groupBy(F.col("after").alias("number")).agg((-F.count("*")).alias("step"))
    ).groupBy("number").agg(F.sum("step").alias("step"))
    open_spans = F.sum("step").over(W.orderBy("number").rowsBetween(W.unboundedPreceding, W.currentRow))
    return days.join(steps, "number", "left").select("date", "number", open_spans.alias("spans")).where("spans > 0").drop("spans")


def next_day_returns(pairs: DataFrame, prices: DataFrame, fill: str | None = "pad") -> DataFrame:
    """``pairs`` (date, ticker, ...) on days with returns, with ``fwd_ret``: equals their join with ``forward_returns(returns(prices, fill))``.

    Returns are worked out for the pairs only, not for every ticker and day. A pair is placed on the next day with returns, between its ticker's
    closes; one sorted pass over both finds the close of that day and the last one before. Only day lists are broadcast (see `calendar_grid`).
    """
    if fill not in ("pad", None):
        raise ValueError(f"fill must be 'pad' or None, not {fill!r}")
    days = prices.select("date").distinct().select("date", F.row_number().over(W.orderBy("date")).alias("number"))
    closes = prices.join(F.broadcast(days), "date").select("ticker", "number", "close")
    kept = _days_with_returns(days, closes, fill)
    places = kept.select("date", F.lead("number").over(W.orderBy("date")).alias("number"))

    asked = pairs.join(F.broadcast(places), "date").select("ticker", "number", F.struct(*pairs.columns).alias("pair"))
    both = asked.unionByName(closes, allowMissingColumns=True)
    by_number = W.partitionBy("ticker").orderBy("number")
    now = F.max("close").over(by_number.rangeBetween(0, 0))
    if fill == "pad":
        before = F.last("close", ignorenulls=True).over(by_number.rangeBetween(W.unboundedPreceding, -1))
        now = F.coalesce(now, before)
    else:
        before = F.max("close").over(by_number.rangeBetween(-1, -1))
    ret = F.try_divide(now, before) - 1
    return both.withColumn("fwd_ret", ret).where("pair is not null").select("pair.*", "fwd_ret")


def drop_incomplete(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Removes rows with a NULL or NaN in one of the columns."""
    return rows.dropna(subset=list(columns))
