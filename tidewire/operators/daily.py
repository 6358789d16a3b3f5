"""Daily aggregates, reshaping, selections and feeds over the scored frame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import utc_day
from ..schemas import FEED_COLUMNS


def day_of(frame: DataFrame, column: str = "published_at") -> Column:
    """UTC day of a time column of the frame."""
    return utc_day(F.col(column), frame.schema[column].dataType)


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """Per ticker and UTC day: mean score, row count, mean confidence.

    Rows without a ticker or time drop out; NaN is left out of the means but counted. Means are
    partial sums before the shuffle, so a ticker with a large share of the rows costs no more.
    """
    def mean(name: str) -> Column:
        return F.avg(F.nanvl(F.col(name), F.lit(None).cast("double")))

    return (
        scored.select("ticker", day_of(scored).alias("date"), "score", "confidence")
        .where("ticker is not null and date is not null")
        .groupBy("ticker", "date")
        .agg(
            mean("score").alias("sentiment"),
            F.count(F.lit(1)).alias("n"),
            mean("confidence").alias("confidence"),
        )
    )


def daily_partials(scored: DataFrame) -> DataFrame:
    """Per ticker and UTC day: sums and counts that partials of other rows can be added to."""
    def known(name: str) -> Column:
        return F.nanvl(F.col(name), F.lit(None).cast("double"))

    rows = scored.select("ticker", day_of(scored).alias("date"), known("score").alias("score"), known("confidence").alias("confidence"))
    return rows.where("ticker is not null and date is not null").groupBy("ticker", "date").agg(
        F.sum("score").alias("score_sum"),
        F.count("score").alias("score_n"),
        F.sum("confidence").alias("confidence_sum"),
        F.count("confidence").alias("confidence_n"),
        F.count(F.lit(1)).alias("n"),
    )


def daily_from_partials(partials: DataFrame) -> DataFrame:
    """The daily table of all rows whose partials are given; equals `daily_sentiment` of those rows."""
    return partials.groupBy("ticker", "date").agg(
        F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("sentiment"),
        F.sum("n").alias("n"),
        F.try_divide(F.sum("confidence_sum"), F.sum("confidence_n")).alias("confidence"),
    )


def pivot_sentiment(daily: DataFrame, tickers: Iterable[str] | None = None) -> DataFrame:
    """One row per day, one column per ticker. A repeated (day, ticker) is an error.

    Passing the tickers saves the job that finds them, and bounds the width; without them, Spark
    finds them and refuses beyond ``spark.sql.pivotMaxValues``. The wide form is for output:
    everything else here works on the long form.
    """
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pivot: repeated (date, ticker)"))).otherwise(
        F.first("sentiment")
    )
    columns = sorted(tickers) if tickers is not None else None
    return daily.groupBy("date").pivot("ticker", columns).agg(cell)


def unpivot_wide(wide: DataFrame, value: str = "value") -> DataFrame:
    """Wide (date, one column per ticker) to long (date, ticker, value) without empty cells."""
    columns = [f"`{name}`" for name in wide.columns if name != "date"]
    return wide.unpivot("date", columns, "ticker", value).where(F.col(value).isNotNull())


def wide_map(daily: DataFrame, value: str = "sentiment") -> DataFrame:
    """The wide form for any number of tickers: date, and a map from ticker to value.

    The plan and the schema are the same for ten tickers as for a million; a row has the tickers of its day. Empty cells have no entry. A repeated
    (day, ticker) is an error.
    """
    entry = F.struct("ticker", F.col(value).alias("value"))
    filled = daily.where(F.col("ticker").isNotNull() & F.col(value).isNotNull())
    many = F.count(F.lit(1)) > F.count_distinct("ticker")
    cells = F.when(many, F.raise_error(F.lit("wide: repeated (date, ticker)"))).otherwise(F.map_from_entries(F.sort_array(F.collect_list(entry))))
    return filled.groupBy("date").agg(cells.alias(value))


def unpivot_map(wide: DataFrame, value: str = "sentiment") -> DataFrame:
    """`wide_map` back to long: date, ticker, value."""
    return wide.select("date", F.explode(value).alias("ticker", value))


def for_ticker(rows: DataFrame, ticker: str | None) -> DataFrame:
    """Rows of one ticker; none given means all. The argument is upper-cased, the column is not."""
    return rows.where(F.col("ticker") == ticker.upper()) if ticker else rows


def for_tickers(rows: DataFrame, tickers: Iterable[str]) -> DataFrame:
    """Rows of several tickers; an empty selection means all."""
    wanted = list(tickers)
    return rows.where(F.col("ticker").isin(wanted)) if wanted else rows


def distinct_tickers(rows: DataFrame) -> DataFrame:
    return rows.select("ticker").distinct().orderBy("ticker")


def default_selection(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first n tickers in alphabetical order."""
    return distinct_tickers(rows).limit(n)


def ticker_summary(scored: DataFrame) -> DataFrame:
    """Row count and mean score per ticker."""
    return scored.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_sentiment"))


def run_counters(rows: DataFrame) -> DataFrame:
    """Status of a store in one pass: rows by source, scored rows, days with a score.

    Takes headlines with their scores outer-joined, or the scored frame.
    """
    scored_day = F.when(F.col("score").isNotNull(), day_of(rows))
    sources = rows.select("source", F.col("score").isNotNull().alias("scored"), scored_day.alias("day"))
    by_source = sources.groupBy("source", "day").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("scored").alias("scored_rows")
    )
    per_source = by_source.groupBy("day").agg(
        F.sum(F.when(F.col("source") == "yfinance", F.col("rows"))).alias("news_rows"),
        F.sum(F.when(F.col("source") == "reddit", F.col("rows"))).alias("forum_rows"),
        F.sum("scored_rows").alias("scored_rows"),
    )
    return per_source.agg(
        F.coalesce(F.sum("news_rows"), F.lit(0)).alias("news_rows"),
        F.coalesce(F.sum("forum_rows"), F.lit(0)).alias("forum_rows"),
        F.coalesce(F.sum("scored_rows"), F.lit(0)).alias("scored_rows"),
        F.count("day").alias("sentiment_days"),
    )


def latest_feed(scored: DataFrame, n: int = 50, tie: str = "url") -> DataFrame:
    """The n newest rows for display; ties are broken by a key so that the feed repeats."""
    return scored.orderBy(F.desc("published_at"), tie).limit(n).select(*FEED_COLUMNS)


def top_scored(scored: DataFrame, k: int, tie: str = "url") -> DataFrame:
    """The k best scored rows."""
    return scored.orderBy(F.desc("score"), tie).limit(k).select("ticker", "label", "score", "title")


def require_days(daily: DataFrame, min_days: int) -> DataFrame:
    """The daily frame, or nothing of it when it spans fewer than ``min_days`` days.

    The dashboard asks for 5 days, the pipeline for 2.
    """
    days = daily.agg(F.count_distinct("date").alias("days")).scalar()
    return daily.where(days >= min_days)


def backtest_range(
    daily: DataFrame, pad_days: int = 3, lookback: int | None = None, as_of: str | None = None
) -> DataFrame:
    """One row (start, end): the sentiment days, padded, for the price scan.

    With ``lookback``, the start is no earlier than that many days before ``as_of``.
    """
    span = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    start = F.date_sub("lo", pad_days)
    if lookback is not None:
        # greatest() skips NULLs, and an empty frame must have no range.
        floor = F.date_sub(F.lit(as_of).cast("date"), lookback)
        start = F.when(F.col("lo").isNotNull(), F.greatest(start, floor))
    return span.select(start.alias("start"), F.date_add("hi", pad_days).alias("end"))
