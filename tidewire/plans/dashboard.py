"""The tables behind the dashboard, for one selection of tickers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..operators.backtest import backtest
from ..operators.daily import (
    backtest_range,
    daily_sentiment,
    default_selection,
    distinct_tickers,
    for_tickers,
    latest_feed,
    require_days,
)
from ..session import materialize
from ..sources.landed import select_prices

MIN_DAYS = 5  # fixed value
FEED_ROWS = 50  # fixed value


def dashboard_tables(
    scored: DataFrame, prices: DataFrame, selection: Iterable[str] | None = None, tie: str = "url"
) -> dict[str, DataFrame]:
    """tickers, daily, feed, and with a selection: aligned, equity, metrics.

    ``selection=None`` takes the first three tickers; an empty selection shows all rows, without
    a backtest. The daily table is computed once, since the guard, the range and the backtest
    read it. Cache or store ``scored`` when several selections are asked for.
    """
    if selection is None:
        # At most three rows, whatever the data.
        view = scored.join(default_selection(scored).hint("broadcast"), "ticker", "left_semi")
        selected = True
    else:
        selection = list(selection)
        view = for_tickers(scored, selection)
        selected = bool(selection)
    daily = materialize(daily_sentiment(view), "dashboard-daily")
    tables = {
        "tickers": distinct_tickers(scored),
        "daily": daily.orderBy("ticker", "date"),
        "feed": latest_feed(view, FEED_ROWS, tie),
    }
    if selected:
        span = backtest_range(daily)
        wanted = select_prices(prices, start=span.select("start").scalar(), end=span.select("end").scalar())
        wanted = wanted.join(daily.select("ticker").distinct(), "ticker", "left_semi")
        aligned, equity, metrics = backtest(require_days(daily, MIN_DAYS), wanted)
        tables |= {
            "aligned": aligned.orderBy("date", "ticker"),
            "equity": equity.orderBy("date"),
            "metrics": metrics,
        }
    return tables
