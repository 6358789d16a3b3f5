"""One run: ingest, score, aggregate, backtest. Safe to repeat: a second run stores nothing new."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_watchlist
from ..operators.backtest import backtest, equity_curve
from ..operators.backtest import metrics as signal_metrics
from ..operators.daily import backtest_range, daily_from_partials, daily_partials, pivot_sentiment, require_days
from ..operators.keyed import insert_counts, insert_if_absent, scored_frame, union_sources
from ..operators.normalize import normalize_news, normalize_posts
from ..operators.scoring import score_pending
from ..schemas import DAILY
from ..session import local_frame, materialize
from ..sources.landed import read_listing, read_news, read_prices
from ..sources.tables import (
    STORE_KEY,
    add_daily_partials,
    append_headlines,
    append_scores,
    create_store,
    read_daily_partials,
    read_headlines,
    read_scores,
    replace_daily_partials,
    write_results,
)

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunConfig:
    """Arguments of a run. ``as_of`` (date or timestamp text, UTC) stands in for the current time."""

    news_path: str
    prices_path: str
    store: str
    watch: str | Iterable[str]
    as_of: str
    forum_path: str | None = None
    backend: str | None = None
    score_options: dict = field(default_factory=dict)
    start: str | None = None
    end: str | None = None
    min_days: int = 2
    pad_days: int = 3
    lookback: int = 365
    prices_format: str = "parquet"
    wide: str | Iterable[str] | None = None

    @property
    def now(self) -> Column:
        moment = F.to_timestamp_ntz(F.lit(self.as_of))
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), moment).cast("timestamp")


def ingest(spark: SparkSession, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """Stores new headlines of both sources; returns the inserted rows per watched ticker, and the news feed's lines and rejected lines.

    Lines are counted as they are parsed, in the job that finds the new headlines (of forum listings, see `read_rejected`).
    """
    create_store(spark, config.store)
    counts = Observation()
    batch = normalize_news(read_news(spark, config.news_path, counts), config.now, config.watch)
    if config.forum_path:
        try:
            posts = read_listing(spark, config.forum_path)
            batch = union_sources(batch, normalize_posts(posts, config.watch, config.now))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("no forum listing at %s: going on with news only", config.forum_path)
    path = f"{config.store}/headlines"
    # The id is made of the key, and the store is bucketed by it: the history isn't moved.
    new = materialize(insert_if_absent(batch, read_headlines(spark, path), (STORE_KEY,)), "new-headlines")
    append_headlines(new, path)
    rejected = local_frame(spark, [("news", counts.get["lines"], counts.get["rejected"])], "feed string, lines long, rejected long")
    return materialize(insert_counts(new, config.watch), "inserted"), rejected


def score_store(spark: SparkSession, config: RunConfig) -> DataFrame:
    """Scores the stored headlines that have no score; returns the new scores."""
    headlines = read_headlines(spark, f"{config.store}/headlines")
    scores = read_scores(spark, f"{config.store}/scores")
    pending = materialize(score_pending(headlines, scores, config.backend, **config.score_options), "new-scores")
    append_scores(pending, f"{config.store}/scores")
    return pending


def _in_time(scored: DataFrame) -> DataFrame:
    """Rows in tasks of even size, by time within a task: then sums of doubles, whose last bits depend on their order, don't hang on the store's buckets."""
    rows = scored.select("ticker", "published_at", "url", "score", "confidence")
    return rows.hint("rebalance").sortWithinPartitions("published_at", "url")


def update_daily(spark: SparkSession, store: str, new_scores: DataFrame) -> DataFrame:
    """The daily table, of partials that are kept by day (many days: by several): only the folders of new scores are read and rewritten.

    The partials must have as many rows as there are scores; where they don't, as after a run that was cut short between the two, or in a
    store that has none yet, all days are computed anew.
    """
    headlines, scores = read_headlines(spark, f"{store}/headlines"), read_scores(spark, f"{store}/scores")
    path = f"{store}/daily"
    add_daily_partials(daily_partials(_in_time(scored_frame(headlines, new_scores))), path)
    counted = read_daily_partials(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if counted != scores.count():
        log.warning("the daily partials have %d rows of another number of scores: computing all days anew", counted)
        replace_daily_partials(daily_partials(_in_time(scored_frame(headlines, scores))), path)
    return daily_from_partials(read_daily_partials(spark, path))


def run_end_to_end(spark: SparkSession, config: RunConfig) -> dict[str, DataFrame]:
    """Runs all steps and returns their tables: inserted, rejected, scored, daily, wide, aligned, equity, metrics.

    Results are written to ``store/results/<run>``, a new folder each time, so that the tables of an
    earlier run stay readable. ``wide`` has a column for each ticker of ``wide`` in the arguments (the watchlist
    by default) that has a day.

    Headlines, scores and daily partials grow by what is new; a run reads the history only for the ids of the two tables, in place.
    The daily table of a run is written before it is used: the guard, the date range and the backtest all read it.
    """
    inserted, rejected = ingest(spark, config)
    new_scores = score_store(spark, config)

    results = f"{config.store}/results/{uuid.uuid4().hex}"
    write_results(results, daily=update_daily(spark, config.store, new_scores).select(DAILY.names))
    daily = spark.read.schema(DAILY).parquet(f"{results}/daily")

    # no more than the argument names
    shown = daily.where(F.col("ticker").isin(normal_watchlist(config.wide or config.watch)))
    shown = [row["ticker"] for row in shown.select("ticker").distinct().collect()]
    lookback = None if config.start else config.lookback
    span = backtest_range(daily, config.pad_days, lookback, config.as_of)
    prices = read_prices(
        spark,
        config.prices_path,
        start=config.start or span.select("start").scalar(),
        end=config.end or span.select("end").scalar(),
        fmt=config.prices_format,
    ).join(daily.select("ticker").distinct(), "ticker", "left_semi")
    signal, equity, metrics = backtest(require_days(daily, config.min_days), prices)
    write_results(results, aligned=signal)
    aligned = spark.read.schema(signal.schema).parquet(f"{results}/aligned")
    equity = equity_curve(aligned)
    metrics = signal_metrics(aligned, equity)
    write_results(results, equity=equity, metrics=metrics)
    return {
        "inserted": inserted,
        "rejected": rejected,
        "scored": new_scores.agg(F.count("*").alias("scored")),
        "daily": daily.orderBy("ticker", "date"),
        "wide": pivot_sentiment(daily, shown).orderBy("date"),
        "aligned": aligned.orderBy("date", "ticker"),
        "equity": spark.read.schema(equity.schema).parquet(f"{results}/equity").orderBy("date"),
        "metrics": spark.read.schema(metrics.schema).parquet(f"{results}/metrics"),
    }
