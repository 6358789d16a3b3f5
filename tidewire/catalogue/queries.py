"""One query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators as op
from .. import streaming
from ..functions import first_time, item_times, key_id, label_of, parse_watchlist, ticker_mentions
from ..plans import RunConfig, dashboard_tables, run_end_to_end
from ..schemas import LEXICON
from ..session import fresh_dir, local_frame
from ..sources import read_headlines, read_scores, rejected
from ..sources.landed import parse_listing, parse_news
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Means can be exact ties at six places, and a sum in another order moves them off the tie. The
# nudge, which the SQL has too, makes both round them up.
NUDGE = 1e-9


def r6(name: str) -> Column:
    return F.round(F.col(name) + NUDGE, 6).alias(name)


def _daily(spark, sf):
    return op.daily_sentiment(b.scored_events(spark, sf))


def _forward(spark, sf):
    return op.forward_returns(op.returns(b.order_prices(spark, sf)))


def _backtest(spark, sf):
    return op.backtest(_daily(spark, sf), b.order_prices(spark, sf))


# Daily aggregates, reshaping, feeds

@_query
def daily_sentiment(spark, sf):
    return _daily(spark, sf).select("ticker", "date", r6("sentiment"), "n", r6("confidence"))


@_query
def sentiment_pivot(spark, sf):
    wide = op.pivot_sentiment(_daily(spark, sf))
    return wide.select("date", *[r6(name) for name in wide.columns if name != "date"])


@_query
def unpivot_sentiment(spark, sf):
    return op.unpivot_wide(op.pivot_sentiment(_daily(spark, sf)), "sentiment").select(
        "date", "ticker", r6("sentiment")
    )


@_query
def wide_map(spark, sf):
    """The wide form as maps, and back."""
    return op.unpivot_map(op.wide_map(_daily(spark, sf))).select("date", "ticker", r6("sentiment"))


@_query
def ticker_summary(spark, sf):
    return op.ticker_summary(b.scored_events(spark, sf)).select("ticker", "n", r6("mean_sentiment"))


@_query
def run_counters(spark, sf):
    return op.run_counters(b.scored_events(spark, sf))


@_query
def distinct_tickers(spark, sf):
    return op.distinct_tickers(b.scored_events(spark, sf))


@_query
def default_selection(spark, sf):
    return op.default_selection(b.scored_events(spark, sf))


@_query
def latest_feed(spark, sf):
    feed = op.latest_feed(b.scored_events(spark, sf))
    moment = b.micros(b.instant(F.col("published_at"))).alias("published_at")
    return feed.select(moment, "ticker", "source", "label", r6("score"), "title", "publisher", "url")


@_query
def top_scored(spark, sf):
    return op.top_scored(b.scored_events(spark, sf), 20).select("ticker", "label", r6("score"), "title")


@_query
def ticker_filter(spark, sf):
    return op.for_ticker(b.scored_events(spark, sf), "click").select("event_id", "ticker", r6("score"))


@_query
def multi_select(spark, sf):
    return op.for_tickers(b.scored_events(spark, sf), ["CLICK", "VIEW"]).select("event_id", "ticker", r6("score"))


@_query
def min_history(spark, sf):
    return op.require_days(_daily(spark, sf), 5).select("ticker", "date", r6("sentiment"), "n")


@_query
def min_history_unmet(spark, sf):
    return op.require_days(_daily(spark, sf), 10000).select("ticker", "date", r6("sentiment"), "n")


@_query
def backtest_range(spark, sf):
    return op.backtest_range(_daily(spark, sf), pad_days=3, lookback=40, as_of="2024-02-01")


# Keyed set logic

@_query
def insert_if_absent(spark, sf):
    new = op.insert_if_absent(b.all_headlines(spark, sf), b.labelled_headlines(spark, sf))
    return new.select("source", "url", "ticker", "title", b.micros(F.col("published_at")).alias("published_at"), "publisher")


@_query
def insert_if_absent_small_batch(spark, sf):
    new = op.insert_if_absent(b.all_headlines(spark, sf), b.labelled_headlines(spark, sf), small_batch=True)
    return new.select("source", "url", "ticker", "title", "publisher")


@_query
def insert_per_ticker_key(spark, sf):
    new = op.insert_if_absent(
        b.all_headlines(spark, sf), b.labelled_headlines(spark, sf), ("source", "url", "ticker")
    )
    return new.select("source", "url", "ticker", "publisher")


@_query
def score_per_ticker_key(spark, sf):
    """Scores after an insert by (source, url, ticker): the id is made of the same columns."""
    keys = ("source", "url", "ticker")
    new = op.insert_if_absent(b.document_headlines(spark, sf), b.labelled_headlines(spark, sf), keys)
    named = new.withColumn("headline_id", key_id(*[F.col(name) for name in keys]))
    stored = b.label_scores(spark, sf)
    return op.score_pending(named, stored, "vader", lexicon=b.lexicon(spark), rules=b.PROSE_RULES)


@_query
def insert_counts(spark, sf):
    new = op.insert_if_absent(b.all_headlines(spark, sf), b.labelled_headlines(spark, sf))
    return op.insert_counts(new, b.LANGUAGES)


@_query
def scoring_backlog(spark, sf):
    return op.scoring_backlog(b.document_ids(spark, sf), b.label_scores(spark, sf))


@_query
def write_scores_once(spark, sf):
    stored = b.label_scores(spark, sf).where("score < 1")
    new = op.insert_if_absent(b.competing_scores(spark, sf), stored, ("headline_id",), ("turn",))
    return new.select("headline_id", "label", r6("score"), "confidence", "model")


@_query
def scored_join(spark, sf):
    frame = op.scored_frame(b.document_ids(spark, sf), b.label_scores(spark, sf))
    return frame.withColumn("published_at", b.micros(F.col("published_at")))


@_query
def source_union(spark, sf):
    both = op.union_sources(b.document_headlines(spark, sf).drop("doc_id"), b.page_headlines(spark, sf))
    return both.select("source", "url", "ticker", "title", "publisher")


# Raw rows

@_query
def ticker_mention_arrays(spark, sf):
    found = ticker_mentions(F.col("title"), b.EVENT_TICKERS)
    return b.scored_events(spark, sf).select("event_id", F.array_join(found, ",").alias("mentions"))


@_query
def mention_rows(spark, sf):
    posts = b.scored_events(spark, sf).select("event_id", "title")
    return op.explode_mentions(posts, b.EVENT_TICKERS).select("event_id", "ticker")


@_query
def watchlist_parse(spark, sf):
    text = F.concat(F.lit(" "), F.col("event_type"), F.lit(", ,x"), F.col("user_id"), F.lit(" ,, Spy"))
    return b.table(spark, sf, "events").select("event_id", F.array_join(parse_watchlist(text), "|").alias("names"))


@_query
def coerced_times(spark, sf):
    lines = b.event_news_lines(spark, sf)
    items = lines.select("event_id", F.try_variant_get(F.try_parse_json("value"), "$.item", "variant").alias("item"))
    items = items.select("event_id", item_times(F.col("item")).alias("times"))
    return items.select("event_id", b.micros(first_time(F.col("times"), b.as_of())).alias("published_at"))


@_query
def news_normalize(spark, sf):
    rows = op.normalize_news(parse_news(b.event_news_lines(spark, sf)), b.as_of())
    return rows.select(
        "headline_id", "source", "ticker", "title", "url",
        b.micros(F.col("published_at")).alias("published_at"), "publisher",
    )


@_query
def forum_normalize(spark, sf):
    rows = op.normalize_posts(parse_listing(b.document_listing_lines(spark, sf)), b.LANGUAGES, b.as_of())
    return rows.select(
        "source", "ticker", "title", "url", b.micros(F.col("published_at")).alias("published_at"), "publisher"
    )


# Scoring

@_query
def label_thresholds(spark, sf):
    return b.scored_events(spark, sf).select("event_id", label_of(F.col("score")).alias("label"))


def _probabilities(spark, sf):
    """Three classes per event; empty for errors, tied for views."""
    up = F.least(F.col("value") / 200.0, F.lit(0.6))
    down = F.when(F.col("event_type") == "view", up).otherwise(
        F.get_json_object("props", "$.k").cast("double") / 250.0
    )
    classes = F.create_map(
        F.lit("Neutral"), F.lit(0.15), F.lit("POSITIVE"), up, F.lit("Negative"), down
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return b.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", empty).otherwise(classes).alias("probs")
    )


@_query
def prob_fold(spark, sf):
    return op.fold_probabilities(_probabilities(spark, sf)).select(
        "event_id", "label", r6("score"), r6("confidence")
    )


def _texts(spark, sf):
    return b.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("headline_id"), F.col("text").alias("title")
    )


@_query
def lexicon_score(spark, sf):
    return op.lexicon_score(_texts(spark, sf), b.lexicon(spark), b.PROSE_RULES)


@_query
def lexicon_score_large(spark, sf):
    return op.lexicon_score(_texts(spark, sf), b.lexicon(spark), b.PROSE_RULES, broadcast=False)


def _length_model():
    """A stand-in for a classifier: shares from the length of a text."""
    # Nested, so that it travels to the workers by value.
    def load():
        def predict(texts):
            shares = [1.0 / (1.0 + len(text)) for text in texts]
            return [[("Positive", 0.5), ("Negative", share), ("Neutral", 0.5 - share)] for share in shares]

        return predict

    return load


def _no_model():
    def load():
        raise RuntimeError("no model on this worker")

    return load


@_query
def model_score(spark, sf):
    scored = op.model_score(_texts(spark, sf), _length_model(), "length", b.lexicon(spark))
    return scored.select("headline_id", "label", r6("score"), r6("confidence"), "model")


@_query
def model_fallback(spark, sf):
    return op.model_score(_texts(spark, sf), _no_model(), "length", b.lexicon(spark), rules=b.PROSE_RULES)


@_query
def score_pending(spark, sf):
    texts = b.document_ids(spark, sf).drop("title").join(_texts(spark, sf), "headline_id")
    return op.score_pending(
        texts, b.label_scores(spark, sf), "vader", lexicon=b.lexicon(spark), rules=b.PROSE_RULES
    )


# Returns and backtest

@_query
def price_grid(spark, sf):
    return op.calendar_grid(b.order_prices(spark, sf)).select("date", "ticker", r6("close"))


@_query
def returns(spark, sf):
    return op.returns(b.order_prices(spark, sf)).select("date", "ticker", r6("ret"))


@_query
def returns_unfilled(spark, sf):
    return op.returns(b.order_prices(spark, sf), fill=None).select("date", "ticker", r6("ret"))


@_query
def forward_returns(spark, sf):
    return _forward(spark, sf).select("date", "ticker", r6("fwd_ret"))


@_query
def align(spark, sf):
    return op.align_prices(_daily(spark, sf), b.order_prices(spark, sf)).select(
        "date", "ticker", r6("sentiment"), r6("fwd_ret")
    )


@_query
def universe(spark, sf):
    return op.common_tickers(_daily(spark, sf), _forward(spark, sf))


@_query
def median_split_signal(spark, sf):
    signal, _, _ = _backtest(spark, sf)
    return signal.select("date", "ticker", r6("sentiment"), r6("fwd_ret"), "signal", r6("pnl"))


@_query
def equity_curve(spark, sf):
    _, equity, _ = _backtest(spark, sf)
    return equity.select("date", r6("pnl"), r6("equity"))


def _metrics():
    return [r6("cumulative_return"), r6("sharpe"), r6("correlation"), "n_days"]


@_query
def backtest_metrics(spark, sf):
    _, _, metrics = _backtest(spark, sf)
    return metrics.select(*_metrics())


@_query
def backtest_by_strategy(spark, sf):
    """Sentiment and its opposite as two strategies in one job."""
    daily = _daily(spark, sf)
    both = daily.withColumn("strategy", F.lit("follow")).unionByName(
        daily.withColumns({"strategy": F.lit("fade"), "sentiment": -F.col("sentiment")})
    )
    _, _, metrics = op.backtest(both, b.order_prices(spark, sf), partition_cols=["strategy"])
    return metrics.select("strategy", *_metrics())


# Compositions and streams

def _landed(spark, sf):
    """News lines of the events, written out as the files that ingest reads."""
    path = fresh_dir(spark, "landed-news")
    b.event_news_lines(spark, sf).select("value").write.text(path)
    return path


@_query
def end_to_end(spark, sf):
    """Landed news and forum files to metrics, run twice: the second run must change nothing."""
    forum = fresh_dir(spark, "landed-forum")
    b.document_listing_lines(spark, sf).select("value").write.text(forum)
    prices = fresh_dir(spark, "prices")
    b.order_prices(spark, sf).write.parquet(prices)
    config = RunConfig(
        news_path=_landed(spark, sf),
        forum_path=forum,
        prices_path=prices,
        store=fresh_dir(spark, "store"),
        watch="click, error, view, signup, en",
        as_of=b.AS_OF,
        backend="vader",
        score_options={"lexicon": local_frame(spark, b.EVENT_WORDS, LEXICON)},
    )
    run_end_to_end(spark, config)
    again = run_end_to_end(spark, config)
    inserted = again["inserted"].agg(F.sum("inserted")).scalar()
    days = again["daily"].agg(F.count("*")).scalar()
    forum_days = again["daily"].where("ticker = 'EN'").agg(F.count("*")).scalar()
    return again["metrics"].select(
        *_metrics(), inserted.alias("inserted_again"), days.alias("daily_rows"), forum_days.alias("forum_days"))


@_query
def dashboard(spark, sf):
    tables = dashboard_tables(b.scored_events(spark, sf), b.order_prices(spark, sf))
    return tables["metrics"].select(*_metrics())


def _numbered(frame, *order):
    return frame.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@_query
def dashboard_daily(spark, sf):
    """The daily table of the dashboard with the position of each row in its order."""
    daily = dashboard_tables(b.scored_events(spark, sf), b.order_prices(spark, sf))["daily"]
    placed = daily.select("ticker", "date", r6("sentiment"), "n", F.monotonically_increasing_id().alias("id"))
    return _numbered(placed, "id").drop("id")


@_query
def dashboard_feed(spark, sf):
    feed = dashboard_tables(b.scored_events(spark, sf), b.order_prices(spark, sf))["feed"]
    placed = feed.select("url", "ticker", "label", r6("score"), F.monotonically_increasing_id().alias("id"))
    return _numbered(placed, "id").drop("id")


@_query
def dashboard_equity(spark, sf):
    equity = dashboard_tables(b.scored_events(spark, sf), b.order_prices(spark, sf))["equity"]
    placed = equity.select("date", r6("pnl"), r6("equity"), F.monotonically_increasing_id().alias("id"))
    return _numbered(placed, "id").drop("id")


@_query
def dashboard_aligned(spark, sf):
    aligned = dashboard_tables(b.scored_events(spark, sf), b.order_prices(spark, sf))["aligned"]
    placed = aligned.select("date", "ticker", r6("sentiment"), r6("fwd_ret"), F.monotonically_increasing_id().alias("id"))
    return _numbered(placed, "id").drop("id")


@_query
def dashboard_tickers(spark, sf):
    return dashboard_tables(b.scored_events(spark, sf), b.order_prices(spark, sf))["tickers"]


@_query
def ingest_stream(spark, sf):
    """Landed news through the stream, twice with a lost checkpoint: the replay must store nothing."""
    source, store = _landed(spark, sf), fresh_dir(spark, "store")
    for _ in range(2):
        streaming.ingest_stream(
            spark, source, store, fresh_dir(spark, "stream"), b.as_of(), files_per_batch=3
        ).awaitTermination()
    return read_headlines(spark, f"{store}/headlines").select(
        "headline_id", "ticker", "title", "url", b.micros(F.col("published_at")).alias("published_at"), "publisher"
    )


@_query
def ingest_score_stream(spark, sf):
    """News and forum files through the stream, each scored as it is stored."""
    store, forum = fresh_dir(spark, "store"), fresh_dir(spark, "landed-forum")
    b.document_listing_lines(spark, sf).select("value").write.text(forum)
    streaming.ingest_stream(
        spark, _landed(spark, sf), store, fresh_dir(spark, "stream"), b.as_of(), score_backend="vader",
        lexicon=local_frame(spark, b.EVENT_WORDS, LEXICON),
    ).awaitTermination()
    streaming.ingest_stream(
        spark, forum, store, fresh_dir(spark, "stream"), b.as_of(), kind="forum", watch=b.LANGUAGES, score_backend="vader",
        lexicon=b.lexicon(spark), rules=b.PROSE_RULES,
    ).awaitTermination()
    frame = op.scored_frame(read_headlines(spark, f"{store}/headlines"), read_scores(spark, f"{store}/scores"))
    return frame.select("source", "url", "ticker", "label", r6("score"))


@_query
def rejected_lines(spark, sf):
    """Lines of a landed file that are no JSON: here, every tenth document is cut in the middle."""
    lines = b.document_listing_lines(spark, sf)
    cut = F.when(F.col("seq.line") % 10 == 0, F.expr("substring(value, 1, length(value) div 2)")).otherwise(F.col("value"))
    return rejected(lines.select(cut.alias("value"), "seq")).agg(F.count("*").alias("rejected"))


def _event_stream(spark, sf):
    schema = b.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events.select(
        F.upper("event_type").alias("ticker"),
        F.lit("events").alias("source"),
        F.col("event_id").cast("string").alias("url"),
        b.instant(F.col("ts")).alias("published_at"),
        ((F.col("value") - 35.0) / 500.0).alias("score"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("confidence"),
    )


@_query
def daily_stream(spark, sf):
    """All days of the events, from the partial sums of every batch."""
    out = fresh_dir(spark, "partials")
    streaming.daily_partials_stream(_event_stream(spark, sf), out, fresh_dir(spark, "stream")).awaitTermination()
    return streaming.stored_daily(spark, out).select("ticker", "date", r6("sentiment"), "n", r6("confidence"))


@_query
def daily_stream_closed_days(spark, sf):
    """Closed days of the events, in append mode: the form with a watermark."""
    out = fresh_dir(spark, "daily")
    days = streaming.daily_stream(_event_stream(spark, sf))
    (
        days.writeStream.format("parquet")
        .option("checkpointLocation", fresh_dir(spark, "stream"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return spark.read.schema(days.schema).parquet(out).select(
        "ticker", "date", r6("sentiment"), "n", r6("confidence")
    )
