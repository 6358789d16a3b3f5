"""Sentiment against next-day returns: alignment, signal, P&L, metrics."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .returns import drop_incomplete, forward_returns, next_day_returns

TRADING_DAYS = 252  # fixed value
MEDIAN_FROM_DAYS = 3  # fixed value


def align(daily: DataFrame, forward: DataFrame) -> DataFrame:
    """Daily sentiment with the forward return of the same day and ticker.

    Days match exactly: weekend sentiment has no return and drops out.
    """
    keys = ["date", "ticker"]
    extra = [name for name in daily.columns if name not in {*keys, "sentiment", "n", "confidence"}]
    joined = daily.select(*keys, *extra, "sentiment").join(forward.select(*keys, "fwd_ret"), keys)
    return drop_incomplete(joined, ["sentiment", "fwd_ret"])


def align_prices(daily: DataFrame, prices: DataFrame, fill: str | None = "pad") -> DataFrame:
    """`align` from closes: returns are found for the days of the sentiment only."""
    extra = [name for name in daily.columns if name not in {"date", "ticker", "sentiment", "n", "confidence"}]
    pairs = daily.select("date", "ticker", *extra, "sentiment")
    return drop_incomplete(next_day_returns(pairs, prices, fill), ["sentiment", "fwd_ret"])


def common_tickers(daily: DataFrame, forward: DataFrame) -> DataFrame:
    """Tickers with both sentiment and returns. For reports: ``align`` implies it."""
    return daily.select("ticker").distinct().join(forward.select("ticker").distinct(), "ticker", "left_semi")


def median_split_signal(aligned: DataFrame, partition_cols: Iterable[str] = ()) -> DataFrame:
    """+1 above the ticker's own median sentiment, else -1; under 3 days the sign decides (0 is +1).

    The median is exact and over the whole sample; a group is one ticker's days.
    """
    group = W.partitionBy(*partition_cols, "ticker")
    sentiment = F.col("sentiment")
    by_median = F.when(sentiment > F.median("sentiment").over(group), 1).otherwise(-1)
    by_sign = F.when(sentiment >= 0, 1).otherwise(-1)
    enough = F.count(F.lit(1)).over(group) >= MEDIAN_FROM_DAYS
    return aligned.withColumn("signal", F.when(enough, by_median).otherwise(by_sign))


def with_pnl(signal: DataFrame) -> DataFrame:
    return signal.withColumn("pnl", F.col("signal") * F.col("fwd_ret"))


def daily_pnl(signal: DataFrame, partition_cols: Iterable[str] = ()) -> DataFrame:
    """Equal-weight mean P&L over the tickers of a day."""
    return with_pnl(signal).groupBy(*partition_cols, "date").agg(F.avg("pnl").alias("pnl"))


def equity_curve(signal: DataFrame, partition_cols: Iterable[str] = ()) -> DataFrame:
    """Daily P&L and the running product of (1 + P&L), from 1.

    A true product: a day that loses more than everything turns the sign. The window holds one
    row per day; ``partition_cols`` gives every strategy its own curve in one job.
    """
    partition_cols = list(partition_cols)
    window = W.partitionBy(*partition_cols) if partition_cols else W
    so_far = window.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    days = daily_pnl(signal, partition_cols)
    return days.withColumn("equity", F.product(1 + F.col("pnl")).over(so_far))


def metrics(signal: DataFrame, equity: DataFrame, partition_cols: Iterable[str] = ()) -> DataFrame:
    """cumulative_return, sharpe, correlation, n_days; NULL where undefined, n_days 0 when empty.

    Ratios are guarded divisions, since a constant series has no Sharpe ratio or correlation.
    """
    partition_cols = list(partition_cols)
    spread = F.try_divide(F.avg("pnl"), F.stddev_pop("pnl"))
    curve = equity.groupBy(*partition_cols).agg(
        (F.max_by("equity", "date") - 1).alias("cumulative_return"),
        F.when(F.count("pnl") > 1, spread * math.sqrt(TRADING_DAYS)).alias("sharpe"),
        F.count(F.lit(1)).alias("n_days"),
    )
    scale = F.stddev_pop("sentiment") * F.stddev_pop("fwd_ret")
    pearson = F.try_divide(F.covar_pop("sentiment", "fwd_ret"), scale)
    pairs = drop_incomplete(signal, ["sentiment", "fwd_ret"]).groupBy(*partition_cols).agg(
        F.when(F.count(F.lit(1)) > 1, pearson).alias("correlation")
    )
    columns = ["cumulative_return", "sharpe", "correlation", "n_days"]
    both = curve.unionByName(pairs, allowMissingColumns=True)
    return both.groupBy(*partition_cols).agg(*[F.max(name).alias(name) for name in columns])


def backtest(
    daily: DataFrame,
    prices: DataFrame | None = None,
    returns_frame: DataFrame | None = None,
    fill: str | None = "pad",
    partition_cols: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aligned with signal and pnl, equity, metrics) of a daily frame, lazily.

    Give closes, or ready returns (date, ticker, ret). ``partition_cols`` names columns of
    ``daily`` that tell strategies apart. Days are those of all given tickers, but returns are only
    worked out where there is sentiment.
    """
    if (prices is None) == (returns_frame is None):
        raise ValueError("give either prices or returns_frame")
    partition_cols = list(partition_cols)
    aligned = align_prices(daily, prices, fill) if returns_frame is None else align(daily, forward_returns(returns_frame))
    signal = with_pnl(median_split_signal(aligned, partition_cols))
    equity = equity_curve(signal, partition_cols)
    return signal, equity, metrics(signal, equity, partition_cols)
