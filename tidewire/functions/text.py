"""Text expressions: keys, watchlists, ticker mentions, labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MENTION_PATTERN = r"\$([A-Z]{1,5})(?![\p{L}\p{N}_])"
POSITIVE_FROM = 0.05
NEGATIVE_FROM = -0.05


def key_id(*parts: Column) -> Column:
    """Deterministic id of a row: SHA-256 over its key columns (NULL if one is).

    A 64-bit hash would collide at the row counts this is meant for.
    """
    pieces = [piece for part in parts for piece in (F.lit("\x1f"), part)][1:]
    return F.sha2(F.concat(*pieces), 256)


def headline_id(source: Column, url: Column) -> Column:
    """The id of a headline where source and url are its key."""
    return key_id(source, url)


def parse_watchlist(text: Column) -> Column:
    """``"spy, nvda,,"`` -> ``["SPY", "NVDA"]``."""
    names = F.transform(F.split(text, ","), lambda name: F.upper(F.trim(name)))
    return F.filter(names, lambda name: name != "")


def normal_watchlist(watch: str | Iterable[str]) -> list[str]:
    """The same rule for a watchlist passed as an argument; repeats keep their first place."""
    names = watch.split(",") if isinstance(watch, str) else watch
    cleaned = (name.strip().upper() for name in names)
    return list(dict.fromkeys(name for name in cleaned if name))


def mentions(title: Column) -> Column:
    """All distinct ``$TICKER`` mentions of a title, sorted."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(MENTION_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def ticker_mentions(title: Column, watch: Iterable[str]) -> Column:
    """Mentions that are on the watchlist, sorted; NULL or empty title gives an empty array.

    The watchlist is taken as it is: upper-case it before, if that is wanted.
    """
    wanted = list(watch)
    return F.filter(mentions(title), lambda ticker: ticker.isin(wanted))


def label_of(score: Column) -> Column:
    """Three-way label of a signed score; both thresholds are inclusive."""
    return (
        F.when(score >= POSITIVE_FROM, "positive")
        .when(score <= NEGATIVE_FROM, "negative")
        .when(score.isNotNull(), "neutral")
    )
