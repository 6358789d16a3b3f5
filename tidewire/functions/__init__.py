"""Column functions: expressions in, expressions out, all evaluated in the JVM."""

from .text import headline_id, key_id, label_of, parse_watchlist, ticker_mentions
from .times import coerce_ts, epoch_or, first_time, iso_timestamp, item_times, time_fields, utc_day

__all__ = [
    "coerce_ts", "epoch_or", "first_time", "headline_id", "iso_timestamp", "item_times", "key_id", "label_of",
    "parse_watchlist", "ticker_mentions", "time_fields", "utc_day",
]
