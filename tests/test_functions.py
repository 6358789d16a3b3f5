import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import coerce_ts, iso_timestamp, label_of, parse_watchlist, ticker_mentions, utc_day
from tidewire.functions.text import normal_watchlist
from tidewire.session import local_frame

UTC = dt.timezone.utc


def one(spark, rows, schema, column):
    frame = local_frame(spark, rows, schema)
    return [row[0] for row in frame.select(column).collect()]


@pytest.mark.parametrize("title, watch, expected", [
    ("Switched half of $TSLA for $NVDA at noon", ["SPY", "TSLA", "NVDA"], ["NVDA", "TSLA"]),
    ("Only $QQQ here · nothing else", ["NVDA"], []),
    ("", ["NVDA"], []),
    (None, ["NVDA"], []),
    ("$TSLA $NVDA $NVDA", ["NVDA", "TSLA"], ["NVDA", "TSLA"]),
    ("$NVDA1 $nvda $NVDAS $NVDA_x $ABCDEF", ["NVDA"], []),
    ("$BRK.B is fine", ["BRK"], ["BRK"]),
    ("$NVDAé no, $NVDA² no, ($NVDA) yes", ["NVDA"], ["NVDA"]),
    ("$nvda", ["nvda"], []),
])
def test_ticker_mentions(spark, title, watch, expected):
    assert one(spark, [(title,)], "t string", ticker_mentions(F.col("t"), watch)) == [expected]


def test_mentions_with_a_long_watchlist(spark):
    watch = [f"{a}{b}" for a in "ABCDEFGHIJ" for b in "ABCDEFGHIJ"]
    assert one(spark, [("$AB $ZZ $JJ",)], "t string", ticker_mentions(F.col("t"), watch)) == [["AB", "JJ"]]


def test_watchlist(spark):
    assert one(spark, [(" spy, nvda ,,TSLA",)], "t string", parse_watchlist(F.col("t"))) == [["SPY", "NVDA", "TSLA"]]
    assert normal_watchlist(" spy, nvda ,,TSLA,SPY") == ["SPY", "NVDA", "TSLA"]
    assert normal_watchlist(["a", " ", "A"]) == ["A"]


def test_label_bounds(spark):
    scores = [(0.05,), (0.0499,), (-0.05,), (-0.0499,), (0.0,), (None,)]
    assert one(spark, scores, "s double", label_of(F.col("s"))) == [
        "positive", "neutral", "negative", "neutral", "neutral", None]


ISO_TEXTS = [
    "2024-01-01", "20240101", "2024-01-01T10", "2024-01-01T10:20", "2024-01-01 10:20:30", "2024-01-01x10:20:30",
    "2024-01-01T10:20:30Z", "2024-01-01T10:20:30.5Z", "2024-01-01T10:20:30,123456789+05:30", "20240101T102030",
    "20240101T1020", "20240101T102030.25-0330", "2024-W01-1", "2024W011", "2024-W01", "2024W01T10", "2020-W53-7",
    "2024-01-01T10:20:30+05", "2024-01-01T10:20:30+0530", "2024-01-01+05:00", "2024-01-01Z", "1969-12-31T23:59:59Z",
    "2024-02-29", "2023-02-29", "2024", "2024-01", "2024-1-1", " 2024-01-01", "2024-01-01 ", "2024-13-01",
    "2024-01-01T25:00", "2024-01-01T10:2030", "202401-01", "2024-W53-1", "2024-W00-1", "2024-W01-8", "now", "",
    "0000-01-01", "1704067200", "2024-01-01T10:20:30.", "2024-01-01T1020:30",
]


def by_python(text):
    try:
        moment = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    return int((moment - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_iso_as_python_reads_it(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = one(spark, [(text,) for text in ISO_TEXTS], "t string", F.unix_micros(iso_timestamp(F.col("t"))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    wrong = {t: (g, by_python(t)) for t, g in zip(ISO_TEXTS, got) if g != by_python(t)}
    assert not wrong


@pytest.mark.parametrize("item, expected", [
    ('{"providerPublishTime":1704067200.7}', "2024-01-01 00:00:00"),
    ('{"providerPublishTime":"1704067200","published":"2024-01-02"}', "2024-01-02 00:00:00"),
    ('{"providerPublishTime":0,"content":{"displayTime":"2024-01-03T00:00:00Z"}}', "2024-01-03 00:00:00"),
    ('{"providerPublishTime":-5,"pubDate":"2024-01-04T01:02:03"}', "2024-01-04 01:02:03"),
    ('{"providerPublishTime":true}', "2025-05-05 00:00:00"),
    ('{"pubDate":"2024-02-30","published":"2024-01-05"}', "2024-01-05 00:00:00"),
    ('{"pubDate":"20240106","published":"2024-01-05"}', "2024-01-06 00:00:00"),
    ('{"published":"2024-01-05","providerPublishTime":"x","pubDate":"20240107T10"}', "2024-01-07 10:00:00"),
    ('{"pubDate":1704067200}', "2024-01-01 00:00:00"),
    ('{"content":{"pubDate":1704067200,"displayTime":"2024-01-08"}}', "2024-01-08 00:00:00"),
    ('{"providerPublishTime":1704067200000,"pubDate":"2024-01-09"}', "2024-01-09 00:00:00"),
    ('{"pubDate":"2024-01-01T10:00:00+05:00"}', "2024-01-01 05:00:00"),
    ('{"pubDate":null,"content":null}', "2025-05-05 00:00:00"),
    ('{}', "2025-05-05 00:00:00"),
])
def test_coerced_time(spark, item, expected):
    as_of = F.lit("2025-05-05").cast("timestamp")
    got = one(spark, [(item,)], "t string", coerce_ts(F.try_parse_json("t"), as_of).cast("string"))
    assert got == [expected]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Pacific/Auckland"])
def test_utc_day_ignores_the_session_zone(spark, zone):
    moments = [(dt.datetime(2024, 1, 1, 0, 0, tzinfo=UTC),), (dt.datetime(2024, 1, 1, 23, 59, 59, tzinfo=UTC),),
               (dt.datetime(2023, 11, 5, 5, 30, tzinfo=UTC),), (dt.datetime(1969, 12, 31, 12, 0, tzinfo=UTC),)]
    frame = local_frame(spark, moments, "t timestamp")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        days = [row[0] for row in frame.select(utc_day(F.col("t"), T.TimestampType()).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert days == ["2024-01-01", "2024-01-01", "2023-11-05", "1969-12-31"]
