"""Raw news items and forum posts to headline rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import headline_id, mentions, normal_watchlist
from ..functions.times import NESTED_TIME_FIELDS, TIME_FIELDS, epoch_or, first_time, time_fields
from ..session import local_frame
from .keyed import watch_table

# Fixed values.
NEWS_SOURCE = "yfinance"
FORUM_SOURCE = "reddit"
FORUM_PUBLISHER = "r/wallstreetbets"
FORUM_HOST = "https://reddit.com"
TITLE_LENGTH = 500
PUBLISHER_LENGTH = 128

# News comes before forum posts when both bring the same key.
SOURCE_RANK = {NEWS_SOURCE: 0, FORUM_SOURCE: 1}


# The fields of a news item that are read. Times stay VARIANT: a number and the same digits as
# text are different things there.
_NEWS_ITEM = (
    "struct<title string, link string, url string, publisher string, "
    "providerPublishTime variant, pubDate variant, published variant, "
    "content struct<title string, canonicalUrl struct<url string>, clickThroughUrl struct<url string>, "
    "provider struct<displayName string>, pubDate variant, displayTime variant>>"
)


def _filled(field: str) -> Column:
    """Text of a field; empty text counts as missing."""
    return F.nullif(F.col(field), F.lit(""))


def _text(item: str, path: str) -> Column:
    """A JSON field as text; empty text counts as missing."""
    return F.nullif(F.try_variant_get(item, path, "string"), F.lit(""))


def _headline(rows: DataFrame, source: str, rank: Column) -> DataFrame:
    return rows.select(
        headline_id(F.lit(source), F.col("url")).alias("headline_id"),
        F.lit(source).alias("source"),
        "ticker",
        F.substring("title", 1, TITLE_LENGTH).alias("title"),
        "url",
        "published_at",
        F.substring("publisher", 1, PUBLISHER_LENGTH).alias("publisher"),
        F.lit(SOURCE_RANK[source]).alias("source_rank"),
        rank.alias("rank"),
        "seq",
    )


def normalize_news(raw: DataFrame, as_of: Column, watch: str | Iterable[str] | DataFrame | None = None) -> DataFrame:
    """Raw news (ticker, seq, item) -> headline rows plus the arrival order (source_rank, rank, seq).

    The nested block fills in only when the title or the url is missing at the top level, and
    the publisher follows the same condition. Rows without a title or url drop out. With a
    watchlist, only its tickers pass, and its order comes first in the arrival order. It may be a table (ticker, pos).
    """
    ticker, rank, wanted = F.upper("ticker"), F.lit(0), None
    if watch is not None and not isinstance(watch, DataFrame):
        wanted = normal_watchlist(watch)
        raw = raw.where(ticker.isin(wanted))
    # One typed read of the item. It is the output of a generator, since a plain expression would be
    # repeated in every filter that is pushed below it.
    flat = raw.select(
        ticker.alias("ticker"), "seq", F.inline(F.array(F.try_variant_get("item", "$", _NEWS_ITEM)))
    )
    title, url = _filled("title"), F.coalesce(_filled("link"), _filled("url"))
    fill = title.isNull() | url.isNull()
    nested_url = F.coalesce(_filled("content.canonicalUrl.url"), _filled("content.clickThroughUrl.url"))
    times = time_fields(
        [F.col(name) for name in TIME_FIELDS], [F.col(f"content.{name}") for name in NESTED_TIME_FIELDS]
    )
    rows = flat.select(
        "ticker",
        "seq",
        F.coalesce(title, _filled("content.title")).alias("title"),
        F.coalesce(url, nested_url).alias("url"),
        F.coalesce(_filled("publisher"), F.when(fill, _filled("content.provider.displayName"))).alias("publisher"),
        times.alias("times"),
    ).where("title is not null and url is not null")
    rows = rows.withColumn("published_at", first_time(F.col("times"), as_of))
    if wanted is not None:
        # the names come from an argument
        places = local_frame(raw.sparkSession, [(name, place) for place, name in enumerate(wanted, 1)], "ticker string, place int")
        rows, rank = rows.join(F.broadcast(places), "ticker"), F.col("place")
    elif watch is not None:
        rows, rank = rows.join(watch_table(watch), "ticker"), F.col("place").cast("int")
    return _headline(rows, NEWS_SOURCE, rank)


def explode_mentions(posts: DataFrame, watch: str | Iterable[str] | DataFrame) -> DataFrame:
    """One row per post and watched ticker that its ``title`` mentions; posts with none vanish.

    Mentions are exploded before they are matched, so a long watchlist is a hashed lookup per
    mention. A watchlist of any length can be a table (ticker, pos), which is joined.
    """
    found = posts.withColumn("ticker", F.explode(mentions(F.col("title"))))
    if isinstance(watch, DataFrame):
        return found.join(watch_table(watch), "ticker", "left_semi").select(*found.columns)
    return found.where(F.col("ticker").isin(normal_watchlist(watch)))


def normalize_posts(raw: DataFrame, watch: str | Iterable[str] | DataFrame, as_of: Column) -> DataFrame:
    """Raw posts (seq, post) -> headline rows plus the arrival order, one per mentioned ticker.

    Mentions are looked for in the whole title, which is cut only afterwards.
    """
    link = F.coalesce(_text("post", "$.url"), _text("post", "$.permalink"), F.lit(""))
    posts = raw.select(
        F.coalesce(_text("post", "$.title"), F.lit("")).alias("title"),
        F.when(link.startswith("/"), F.concat(F.lit(FORUM_HOST), link)).otherwise(link).alias("url"),
        epoch_or(F.try_variant_get("post", "$.created_utc", "variant"), as_of).alias("published_at"),
        F.lit(FORUM_PUBLISHER).alias("publisher"),
        "seq",
    )
    rows = explode_mentions(posts, watch)
    # Tickers of one post arrive in alphabetical order.
    rows = rows.withColumn("seq", F.col("seq").withField("mention", F.col("ticker")))
    return _headline(rows, FORUM_SOURCE, F.lit(0))
