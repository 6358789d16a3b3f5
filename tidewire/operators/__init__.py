"""DataFrame operators, from raw rows to tested signals."""

from .backtest import (
    align,
    align_prices,
    backtest,
    common_tickers,
    equity_curve,
    median_split_signal,
    metrics,
)
from .daily import (
    backtest_range,
    daily_from_partials,
    daily_partials,
    daily_sentiment,
    default_selection,
    distinct_tickers,
    for_ticker,
    for_tickers,
    latest_feed,
    pivot_sentiment,
    require_days,
    run_counters,
    ticker_summary,
    top_scored,
    unpivot_map,
    unpivot_wide,
    wide_map,
)
from .keyed import (
    fits_broadcast,
    insert_counts,
    insert_if_absent,
    scored_frame,
    scoring_backlog,
    union_sources,
)
from .lexicon import lexicon_score
from .normalize import explode_mentions, normalize_news, normalize_posts
from .returns import calendar_grid, drop_empty_dates, drop_incomplete, forward_returns, next_day_returns, returns
from .scoring import fold_probabilities, model_score, register_backend, score, score_pending

__all__ = [
    "align", "align_prices", "backtest", "backtest_range", "calendar_grid", "common_tickers", "daily_from_partials", "daily_partials", "daily_sentiment",
    "default_selection", "distinct_tickers", "drop_empty_dates", "drop_incomplete",
    "equity_curve", "explode_mentions", "fits_broadcast", "fold_probabilities", "for_ticker",
    "for_tickers", "forward_returns", "insert_counts", "insert_if_absent", "latest_feed",
    "lexicon_score", "median_split_signal", "metrics", "model_score", "next_day_returns", "normalize_news",
    "normalize_posts", "pivot_sentiment", "register_backend", "require_days", "returns",
    "run_counters", "score", "score_pending", "scored_frame", "scoring_backlog",
    "ticker_summary", "top_scored", "union_sources", "unpivot_map", "unpivot_wide", "wide_map",
]
