"""Daily aggregates, returns and backtest on cases computed by hand."""

import datetime as dt
import math
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from tidewire import operators as op
from tidewire.session import local_frame

DAILY = "date date, ticker string, sentiment double, n long, confidence double"
PRICES = "date date, ticker string, close double"
RETURNS = "date date, ticker string, ret double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def scored_frame(spark):
    levels = {"NVDA": [0.25, 0.75, 0.0, -0.5, 1.0, 0.125, 0.5, -0.25], "TSLA": [-1.0, 0.5, -0.125, 0.375, -0.75, 0.0, 0.625, -0.5]}
    data = [
        (ticker, f"{ticker} {n}", f"story:{ticker}:{n}", "yfinance", dt.datetime(2024, 1, 1 + n, 9, 5 * n, tzinfo=dt.timezone.utc), "desk", "neutral", level, 0.75, "hand")
        for ticker, own in levels.items() for n, level in enumerate(own)
    ]
    return local_frame(spark, data, "ticker string, title string, url string, source string, published_at timestamp, "
                       "publisher string, label string, score double, confidence double, model string")


def test_daily_and_pivot(spark):
    daily = op.daily_sentiment(scored_frame(spark))
    assert daily.columns == ["ticker", "date", "sentiment", "n", "confidence"]
    assert daily.count() == 16 and {row.n for row in daily.collect()} == {1}
    for tickers in (None, ["TSLA", "NVDA"]):
        wide = op.pivot_sentiment(daily, tickers)
        assert wide.columns == ["date", "NVDA", "TSLA"] and wide.count() == 8
    back = op.unpivot_wide(op.pivot_sentiment(daily), "sentiment")
    assert rows(back) == rows(daily.select("date", "ticker", "sentiment"))


def test_daily_nan_and_null(spark):
    moment = dt.datetime(2024, 1, 1, 23, 30, tzinfo=dt.timezone.utc)
    data = [("A", moment, 0.5, 0.8), ("A", moment, math.nan, 0.6), ("A", moment, None, None), (None, moment, 1.0, 1.0),
            ("A", None, 1.0, 1.0), ("B", moment, math.nan, math.nan)]
    daily = op.daily_sentiment(local_frame(spark, data, "ticker string, published_at timestamp, score double, confidence double"))
    assert rows(daily) == [("A", day(0), 0.5, 3, pytest.approx(0.7)), ("B", day(0), None, 1, None)]


def test_pivot_odd_names_and_repeats(spark):
    daily = local_frame(spark, [(day(0), "BRK.B", 0.5, 1, 1.0), (day(1), "A", 0.1, 1, 1.0)], DAILY)
    wide = op.pivot_sentiment(daily)
    assert wide.columns == ["date", "A", "BRK.B"]
    assert rows(op.unpivot_wide(wide)) == [(day(0), "BRK.B", 0.5), (day(1), "A", 0.1)]
    with pytest.raises(Exception, match="repeated"):
        op.pivot_sentiment(daily.union(daily)).collect()


def test_selections_and_feeds(spark):
    scored = scored_frame(spark)
    assert op.for_ticker(scored, "nvda").count() == 8 and op.for_ticker(scored, None).count() == 16
    assert op.for_tickers(scored, ["TSLA"]).count() == 8 and op.for_tickers(scored, []).count() == 16
    assert rows(op.default_selection(scored, 1)) == [("NVDA",)]
    feed = op.latest_feed(scored, 3)
    assert [row.url for row in feed.collect()] == ["story:NVDA:7", "story:TSLA:7", "story:NVDA:6"]
    assert len(feed.columns) == 8
    assert "TakeOrderedAndProject" in feed._jdf.queryExecution().executedPlan().toString()
    assert [row.ticker for row in op.top_scored(scored, 2).collect()] == ["NVDA", "NVDA"]
    assert rows(op.ticker_summary(scored)) == [("NVDA", 8, 0.234375), ("TSLA", 8, -0.109375)]
    assert rows(op.run_counters(scored)) == [(16, 0, 16, 8)]
    assert rows(op.run_counters(scored.limit(0))) == [(0, 0, 0, 0)]


def test_guard_and_range(spark):
    daily = local_frame(spark, [(day(0), "A", 0.5, 1, 1.0), (day(3), "A", 0.1, 1, 1.0)], DAILY)
    assert op.require_days(daily, 2).count() == 2 and op.require_days(daily, 3).count() == 0
    assert rows(op.backtest_range(daily)) == [(dt.date(2023, 12, 29), dt.date(2024, 1, 7))]
    assert rows(op.backtest_range(daily, lookback=10, as_of="2024-01-11")) == [(day(0), dt.date(2024, 1, 7))]
    assert rows(op.backtest_range(daily.limit(0), lookback=10, as_of="2024-01-11")) == [(None, None)]


def holes(spark):
    closes = {"A": [10.0, 11.0, None, 12.0], "B": [None, 5.0, 5.5, 0.0]}
    data = [(day(n), ticker, close) for ticker, values in closes.items() for n, close in enumerate(values)]
    return local_frame(spark, data, PRICES)


@pytest.mark.parametrize("absent", [False, True])
def test_padded_returns(spark, absent):
    prices = holes(spark)
    if absent:  # a gap may be a NULL close or no row at all
        prices = prices.where("close is not null")
    got = rows(op.returns(prices), "ticker", "date")
    assert [(str(d)[-1], t, r if r is None else round(r, 6)) for d, t, r in got] == [
        ("2", "A", 0.1), ("3", "A", 0.0), ("4", "A", 0.090909), ("2", "B", None), ("3", "B", 0.1), ("4", "B", -1.0)]
    forward = {(str(d)[-1], t): f for d, t, f in rows(op.forward_returns(op.returns(prices)))}
    assert round(forward["3", "A"], 6) == 0.090909 and forward["4", "A"] is None and round(forward["2", "B"], 6) == 0.1


def test_grid_and_unfilled_returns(spark):
    prices = holes(spark).where("close is not null").union(local_frame(spark, [(day(9), "C", 1.0)], PRICES))
    grid = op.calendar_grid(prices)
    assert grid.count() == 15 and grid.where("close is not null").count() == 7
    unfilled = op.returns(prices, fill=None)
    assert {(str(row.date)[-1], row.ticker) for row in unfilled.where("ret is not null").collect()} == {
        ("2", "A"), ("3", "B"), ("4", "B")}
    with pytest.raises(ValueError):
        op.returns(prices, fill="other")


def test_zero_close_gives_no_return(spark):
    prices = local_frame(spark, [(day(n), "A", close) for n, close in enumerate([1.0, 0.0, 2.0, 4.0])], PRICES)
    assert [row[2] for row in rows(op.returns(prices))] == [-1.0, 1.0]


def test_returns_need_one_shuffle_of_the_closes(spark):
    frame = op.forward_returns(op.returns(holes(spark)))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan
    spine = plan[: plan.index("BroadcastExchange")]
    assert spine.count("Exchange hashpartitioning(ticker") == 1  # the other is of distinct days


def test_calendar_is_built_before_tickers_are_dropped(spark):
    prices = local_frame(spark, [(day(0), "A", 1.0), (day(2), "A", 2.0), (day(1), "Z", 1.0), (day(2), "Z", 1.0)], PRICES)
    daily = local_frame(spark, [(day(0), "A", 0.5, 1, 1.0), (day(1), "A", 0.5, 1, 1.0)], DAILY)
    aligned = op.align(daily, op.forward_returns(op.returns(prices)))
    assert rows(aligned.select("date", "fwd_ret")) == [(day(1), 1.0)]
    assert rows(op.common_tickers(daily, op.forward_returns(op.returns(prices)))) == [("A",)]


def test_weekend_sentiment_is_dropped(spark):
    daily = local_frame(spark, [(day(5), "A", 0.5, 1, 1.0), (day(4), "A", math.nan, 1, 1.0), (day(3), "A", 0.1, 1, 1.0)], DAILY)
    forward = local_frame(spark, [(day(4), "A", 0.1), (day(3), "A", 0.2)], "date date, ticker string, fwd_ret double")
    assert rows(op.align(daily, forward)) == [(day(3), "A", 0.1, 0.2)]


def aligned_frame(spark, values, ticker="A"):
    data = [(day(n), ticker, sentiment, ret) for n, (sentiment, ret) in enumerate(values)]
    return local_frame(spark, data, "date date, ticker string, sentiment double, fwd_ret double")


def test_signal_rules(spark):
    three = op.median_split_signal(aligned_frame(spark, [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]))
    assert [row.signal for row in three.orderBy("date").collect()] == [-1, -1, 1]
    two = op.median_split_signal(aligned_frame(spark, [(0.0, 0.0), (-0.1, 0.0)]))
    assert [row.signal for row in two.orderBy("date").collect()] == [1, -1]
    flat = op.median_split_signal(aligned_frame(spark, [(0.3, 0.0)] * 4))
    assert {row.signal for row in flat.collect()} == {-1}


def test_backtest_with_given_returns(spark):
    daily = op.daily_sentiment(scored_frame(spark))
    data = [(day(0), ticker, 0.0) for ticker in ("NVDA", "TSLA")]
    data += [(day(n + 1), ticker, 0.01 if n % 2 == 0 else -0.01) for n in range(8) for ticker in ("NVDA", "TSLA")]
    aligned, equity, metrics = op.backtest(daily, returns_frame=local_frame(spark, data, RETURNS))
    assert {row.signal for row in aligned.collect()} == {-1, 1} and aligned.count() == 16
    found = metrics.first()
    # by hand: medians are 0.1875 and -0.0625; the tickers agree on days 1, 2 (wrong) and 6, 7 (right)
    pnl = [0, -0.01, -0.01, 0, 0, 0, 0.01, 0.01]
    curve = [math.prod(1 + p for p in pnl[: n + 1]) for n in range(8)]
    assert found.n_days == 8 and found.cumulative_return == pytest.approx(curve[-1] - 1)
    assert found.sharpe == pytest.approx(0, abs=1e-9)
    assert [row.equity for row in equity.orderBy("date").collect()] == pytest.approx(curve)


def test_metrics_by_hand(spark):
    values = [(0.1, 0.02), (0.4, -1.5), (0.2, 0.03), (0.5, 0.04)]
    signal = op.median_split_signal(aligned_frame(spark, values)).withColumn("pnl", F.col("signal") * F.col("fwd_ret"))
    pnl = [-0.02, -1.5, -0.03, 0.04]
    found = op.metrics(signal, op.equity_curve(signal)).first()
    mean = sum(pnl) / 4
    spread = math.sqrt(sum((p - mean) ** 2 for p in pnl) / 4)
    assert found.cumulative_return == pytest.approx(math.prod(1 + p for p in pnl) - 1)  # below -100 %
    assert found.sharpe == pytest.approx(mean / spread * math.sqrt(252))
    xs, ys = zip(*values)
    mx, my = sum(xs) / 4, sum(ys) / 4
    pearson = sum((x - mx) * (y - my) for x, y in values) / math.sqrt(
        sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))
    assert found.correlation == pytest.approx(pearson)


@pytest.mark.parametrize("values", [[], [(0.1, 0.2)], [(0.1, 0.2)] * 3])
def test_undefined_metrics_are_null(spark, values):
    frame = aligned_frame(spark, values or [(1.0, 1.0)]).limit(len(values))
    signal = op.median_split_signal(frame).withColumn("pnl", F.col("signal") * F.col("fwd_ret"))
    found = op.metrics(signal, op.equity_curve(signal)).first()
    assert (found.sharpe, found.correlation, found.n_days) == (None, None, len(values))
    assert (found.cumulative_return is None) == (not values)


def test_strategies_in_one_job(spark):
    daily = op.daily_sentiment(scored_frame(spark))
    both = daily.withColumn("strategy", F.lit("a")).union(
        daily.withColumn("strategy", F.lit("b")).withColumn("sentiment", -F.col("sentiment")))
    data = [(day(n), "NVDA", 0.01 * n) for n in range(9)]
    returns = local_frame(spark, data, RETURNS)
    _, equity, metrics = op.backtest(both, returns_frame=returns, partition_cols=["strategy"])
    alone = op.backtest(daily, returns_frame=returns)[2].first()
    assert metrics.where("strategy = 'a'").first().cumulative_return == pytest.approx(alone.cumulative_return)
    assert equity.count() == 16 and metrics.count() == 2


def test_backtest_arguments(spark):
    daily = op.daily_sentiment(scored_frame(spark))
    with pytest.raises(ValueError):
        op.backtest(daily)


def test_a_stray_date_adds_one_day(spark):
    closes = [(day(n), ticker, 10.0 + n) for n in (0, 1, 4) for ticker in ("A", "B") if (n, ticker) != (1, "B")]
    frame = local_frame(spark, [(dt.date(1, 1, 1), "A", 9.0), *closes], PRICES)
    grid = op.calendar_grid(frame)
    assert grid.count() == 8 and grid.where("close is null").count() == 2


@pytest.mark.parametrize("fill", ["pad", None])
def test_next_day_returns_equal_the_grid(spark, fill):
    rng = random.Random(11)
    for trial in range(4):
        days = [dt.date(2024, 1, 1) + dt.timedelta(days=n) for n in range(14)]
        closes = [(day, ticker, rng.choice([None, 0.0, 1.0, 2.5, 7.0, float("nan"), 3.0, 4.0])) for ticker in "ABCD" for day in days
                  if rng.random() < (0.9, 0.5, 0.25, 0.1)[trial] and (ticker != "D" or day.day > 9)]
        prices = local_frame(spark, closes, "date date, ticker string, close double")
        pairs = [(day, ticker, name, rng.random()) for ticker in "ABDZ" for day in days + [dt.date(2023, 1, 1), dt.date(2025, 1, 1)] for name in ("x", "y")]
        daily = local_frame(spark, pairs, "date date, ticker string, strategy string, sentiment double")
        grid = op.align(daily, op.forward_returns(op.returns(prices, fill)))
        direct = op.align_prices(daily, prices, fill)
        assert direct.columns == grid.columns
        assert rows(direct) == rows(grid)


def test_next_day_returns_without_a_grid(spark):
    daily = local_frame(spark, [(dt.date(2024, 1, 2), "A", 0.5)], "date date, ticker string, sentiment double")
    prices = local_frame(spark, [(dt.date(2024, 1, n), "A", float(n)) for n in (1, 2, 5)], "date date, ticker string, close double")
    found = op.align_prices(daily, prices)
    assert [row.fwd_ret for row in found.collect()] == [1.5]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert op.align_prices(daily.limit(0), prices).count() == 0 and op.align_prices(daily, prices.limit(0)).count() == 0


def test_wide_maps_of_any_width(spark):
    long = spark.range(24_000).select(
        F.expr("date'2024-01-01' + cast(id div 12000 as int)").alias("date"), F.concat(F.lit("T"), F.col("id") % 12_000).alias("ticker"),
        F.when(F.col("id") % 7 > 0, F.col("id") / 8).alias("sentiment"))
    wide = op.wide_map(long)
    assert wide.count() == 2 and wide.columns == ["date", "sentiment"]
    back = op.unpivot_map(wide)
    filled = long.where("sentiment is not null")
    assert back.count() == filled.count() and back.exceptAll(filled).count() == 0
    with pytest.raises(Exception, match="repeated"):
        op.wide_map(long.union(long.where("ticker = 'T1'"))).collect()
