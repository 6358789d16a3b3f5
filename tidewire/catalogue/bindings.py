"""The given tables as headlines, scores, prices and raw JSON. All rows and whole texts are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import headline_id, label_of
from ..functions.valence import ValenceRules
from ..schemas import LEXICON
from ..session import local_frame
from ..sources.landed import arrival

AS_OF = "2024-03-01 00:00:00"
EVENT_TICKERS = ["CLICK", "ERROR", "SIGNUP", "VIEW"]
LANGUAGES = ["EN", "DE", "ES", "FR", "IT"]

# A small lexicon: plain words, and pieces of the invented prose in its four languages.
WORDS = [
    ("best", 3.0), ("great", 3.0), ("amazing", 3.0), ("success", 2.5), ("wonderful", 2.5),
    ("stupid", -2.5), ("worthless", -2.0), ("disgusting", -2.4), ("disaster", -3.0),
    ("and", 0.4), ("ction", 1.2), ("tion", 0.8), ("ment", 1.1), ("ble", 1.9), ("nicht", -0.9),
    ("ing", 1.5), ("oran", -1.1), ("orre", -1.6), ("keit", -1.2), ("los", -0.6), ("der", 0.3),
]
# Words of the event titles, which read: Said "click" é 17
EVENT_WORDS = [
    ('"click"', 1.5), ('"error"', -2.0), ('"view"', 0.5), ("10", 1.0), ("17", -1.5), ("42", 2.0), ("99", -0.5),
]
# The prose has few boosters and negations of its own, so some of its words stand in for them.
PROSE_RULES = ValenceRules(
    boosters_up=(*ValenceRules().boosters_up, "thly", "que"),
    boosters_down=(*ValenceRules().boosters_down, "ther", "den"),
    negations=(*ValenceRules().negations, "with", "this", "les"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def instant(zoneless: Column) -> Column:
    """A zone-less UTC time as an instant, whatever the session time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), zoneless).cast("timestamp")


def micros(moment: Column) -> Column:
    """Times are compared as epoch microseconds, which no time zone setting changes."""
    return F.unix_micros(moment)


def as_of() -> Column:
    return instant(F.lit(AS_OF).cast("timestamp_ntz"))


def lexicon(spark: SparkSession) -> DataFrame:
    return local_frame(spark, WORDS, LEXICON)


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scored headlines; zone-less times."""
    score = (F.col("value") - 35.0) / 500.0
    return table(spark, folder, "events").select(
        "event_id",
        F.upper("event_type").alias("ticker"),
        F.concat(
            F.lit("$"), F.upper("event_type"), F.lit(" and $X"), F.col("user_id"), F.lit(" or $VIEW")
        ).alias("title"),
        F.concat(F.lit("event://"), F.col("event_id")).alias("url"),
        F.when(F.col("event_type").isin("click", "view"), "yfinance").otherwise("reddit").alias("source"),
        F.col("ts").alias("published_at"),
        F.concat(F.lit("user "), F.col("user_id")).alias("publisher"),
        label_of(score).alias("label"),
        score.alias("score"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("confidence"),
        F.lit("events").alias("model"),
    )


def order_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as daily closes of five tickers, without weekends and with one hole."""
    priority = F.col("o_orderpriority")
    ticker = (
        F.when(priority == "1-URGENT", "CLICK")
        .when(priority == "2-HIGH", "ERROR")
        .when(priority == "3-MEDIUM", "VIEW")
        .when(priority == "4-NOT SPECIFIED", "SIGNUP")
        .otherwise("XPAY")
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int"))
    closes = (
        table(spark, folder, "orders")
        .groupBy(ticker.alias("ticker"), day.alias("date"))
        .agg(F.avg("o_totalprice").alias("close"))
    )
    hole = (F.col("ticker") == "VIEW") & (F.col("date") == "2024-01-10")
    return closes.where((F.weekday("date") < 5) & ~hole).select("date", "ticker", "close")


def document_headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as news rows in arrival order; copies of a text share one url."""
    url = F.concat(F.lit("doc://"), F.md5("text"))
    return table(spark, folder, "documents").select(
        "doc_id",
        headline_id(F.lit("yfinance"), url).alias("headline_id"),
        F.lit("yfinance").alias("source"),
        F.upper("lang").alias("ticker"),
        F.col("text").alias("title"),
        url.alias("url"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("published_at"),
        F.col("source").alias("publisher"),
        F.lit(0).alias("source_rank"),
        F.lit(0).alias("rank"),
        arrival(F.lit("documents"), F.lit(0), F.col("doc_id")).alias("seq"),
    )


def page_headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as forum rows."""
    return table(spark, folder, "pages").select(
        headline_id(F.lit("reddit"), F.col("url")).alias("headline_id"),
        F.lit("reddit").alias("source"),
        F.upper(F.regexp_extract("url", "[.](com|org|net)/([a-z]+)", 2)).alias("ticker"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        "url",
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600).alias("published_at"),
        F.lit("r/wallstreetbets").alias("publisher"),
        F.lit(1).alias("source_rank"),
        F.lit(0).alias("rank"),
        arrival(F.lit("pages"), F.lit(0), F.col("page_id")).alias("seq"),
    )


def all_headlines(spark: SparkSession, folder: str) -> DataFrame:
    return document_headlines(spark, folder).drop("doc_id").unionByName(page_headlines(spark, folder))


def labelled_headlines(spark: SparkSession, folder: str) -> DataFrame:
    """The headlines that count as stored already: those of labelled documents."""
    labels = table(spark, folder, "labels").select("doc_id")
    return document_headlines(spark, folder).join(labels, "doc_id", "left_semi")


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as headlines with a key of their own each."""
    return document_headlines(spark, folder).withColumn("headline_id", F.col("doc_id").cast("string"))


def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    score = (F.col("quality") - F.col("toxic")).cast("double")
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("headline_id"),
        label_of(score).alias("label"),
        score.alias("score"),
        F.lit(0.9).alias("confidence"),
        F.lit("labels").alias("model"),
    )


def competing_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of two models for one table, the labels first."""
    score = F.col("n_chars") / 1000000.0
    lengths = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("headline_id"),
        label_of(score).alias("label"),
        score.alias("score"),
        F.lit(0.5).alias("confidence"),
        F.lit("lengths").alias("model"),
        F.lit(1).alias("turn"),
    )
    return lengths.unionByName(label_scores(spark, folder).withColumn("turn", F.lit(0)))


def event_news_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as landed news lines (value, seq), one raw shape per event type."""
    user, kind = F.col("user_id"), F.col("event_type")
    link = F.concat(F.lit("event://"), F.col("event_id"))
    title = F.concat(F.lit('Said "'), kind, F.lit('" é '), user)
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    seconds = F.unix_micros(instant(F.col("ts"))).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")

    def item(**fields: Column) -> Column:
        return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))

    def nested(**fields: Column) -> Column:
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    no_url = F.when(F.col("value") <= 50, nested(url=link))
    shape = (
        F.when(
            kind == "click",
            item(title=title, link=link, providerPublishTime=seconds.cast("decimal(20,6)"),
                 publisher=F.concat(F.lit("P"), user)),
        )
        .when(kind == "error", item(title=title, url=link, pubDate=F.concat(moment, F.lit("Z"))))
        .when(
            kind == "view",
            item(content=nested(
                title=title, canonicalUrl=nested(url=link), provider=nested(displayName=F.lit("Desk")),
                displayTime=F.concat(moment, F.lit("+05:30")))),
        )
        .when(
            kind == "signup",
            item(title=F.lit(""), link=link, providerPublishTime=F.lit("1704067200"),
                 published=F.date_format("ts", "yyyyMMdd"),
                 content=nested(title=title, provider=nested(displayName=F.lit("Desk")))),
        )
        .otherwise(item(title=title, content=nested(clickThroughUrl=no_url)))
    )
    value = F.concat(F.lit('{"ticker":"'), kind, F.lit('","item":'), shape, F.lit("}"))
    return table(spark, folder, "events").select(
        "event_id", value.alias("value"), arrival(F.lit("events"), F.lit(0), F.col("event_id")).alias("seq")
    )


def document_listing_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as forum listings: one post with the whole text, and one reply."""
    lang = F.upper("lang")

    def post(title: Column, url: Column, permalink: Column, created: Column) -> Column:
        fields = {"title": title, "url": url, "permalink": permalink, "created_utc": created}
        return F.struct(F.struct(*[value.alias(name) for name, value in fields.items()]).alias("data"))

    no_text = F.lit(None).cast("string")
    first = post(
        F.concat(F.lit("$EN "), F.col("text"), F.lit(" $"), lang),
        F.concat(F.lit("doc://"), F.col("doc_id")), no_text, F.col("doc_id") * 3600,
    )
    reply = post(
        F.concat(F.lit("re: $"), lang, F.lit(" $"), lang, F.lit("X $FR")),
        no_text, F.concat(F.lit("/r/d/"), F.col("doc_id")), F.lit(None).cast("bigint"),
    )
    listing = F.struct(F.struct(F.array(first, reply).alias("children")).alias("data"))
    value = F.to_json(listing)
    return table(spark, folder, "documents").select(
        value.alias("value"), arrival(F.lit("documents"), F.lit(0), F.col("doc_id")).alias("seq")
    )
