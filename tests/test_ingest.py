import json

import pytest
from frames import rows
from pyspark.sql import functions as F

from tidewire import operators as op
from tidewire.sources import read_listing, read_news, read_prices

AS_OF = "2025-05-05 00:00:00"

NEWS = [
    ({"title": "t", "link": "u1", "providerPublishTime": 1704067200.7}, ("t", "u1", "2024-01-01 00:00:00", None)),
    ({"title": "t", "url": "u2", "pubDate": "2024-01-01T10:00:00Z"}, ("t", "u2", "2024-01-01 10:00:00", None)),
    ({"title": "t", "link": "u3", "providerPublishTime": "1704067200", "published": "2024-01-02"},
     ("t", "u3", "2024-01-02 00:00:00", None)),
    ({"content": {"title": "t", "canonicalUrl": {"url": "u4"}, "provider": {"displayName": "P"},
                  "pubDate": "2024-01-02T00:00:00Z"}}, ("t", "u4", "2024-01-02 00:00:00", "P")),
    ({"title": "t", "link": "u5", "content": {"provider": {"displayName": "P"}}}, ("t", "u5", AS_OF, None)),
    ({"title": "", "link": "u6", "content": {"title": "t2"}}, ("t2", "u6", AS_OF, None)),
    ({"title": "t", "content": {"canonicalUrl": {}, "clickThroughUrl": {"url": "u7"}}}, ("t", "u7", AS_OF, None)),
    ({"title": "t"}, None),
    ({"title": "t", "content": {"clickThroughUrl": None}}, None),
    ({"title": "é" * 600, "link": "u8", "publisher": "p" * 200}, ("é" * 500, "u8", AS_OF, "p" * 128)),
]


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def test_news_shapes(spark, tmp_path):
    lines = [json.dumps({"ticker": "nvda", "item": item}) for item, _ in NEWS] + ["not json", "", "[1]"]
    (tmp_path / "news.json").write_text("\n".join(lines))
    found = op.normalize_news(read_news(spark, str(tmp_path)), as_of())
    got = found.orderBy("seq").select("title", "url", F.col("published_at").cast("string"), "publisher")
    assert [tuple(row) for row in got.collect()] == [expected for _, expected in NEWS if expected]
    assert {row.ticker for row in found.collect()} == {"NVDA"}


POSTS = [
    {"title": "$TSLA $NVDA $NVDA", "url": "https://a", "created_utc": 1704067200},
    {"title": "$NVDA", "permalink": "/r/x/1", "created_utc": 0},
    {"title": "$NVDA", "url": "", "created_utc": "1704067200"},
    {"title": "$NVDA1 $nvda $NVDAS", "url": "b"},
    {"title": "x" * 600 + " $TSLA", "url": "c", "created_utc": -60.5},
    {},
]


def test_forum_shapes(spark, tmp_path):
    listing = {"data": {"children": [{"data": post} for post in POSTS] + [{}, {"data": None}]}}
    (tmp_path / "listing.json").write_text(json.dumps(listing) + "\n{}\nbroken\n" + '{"data":{"children":null}}')
    found = op.normalize_posts(read_listing(spark, str(tmp_path)), "nvda, tsla", as_of())
    got = found.orderBy("seq").select("ticker", F.length("title"), "url", F.col("published_at").cast("string"))
    assert [tuple(row) for row in got.collect()] == [
        ("NVDA", 17, "https://a", "2024-01-01 00:00:00"),
        ("TSLA", 17, "https://a", "2024-01-01 00:00:00"),
        ("NVDA", 5, "https://reddit.com/r/x/1", "1970-01-01 00:00:00"),
        ("NVDA", 5, "", AS_OF),
        ("TSLA", 500, "c", "1969-12-31 23:59:00"),
    ]
    stored = op.insert_if_absent(found, found.limit(0))
    assert [row.ticker for row in stored.orderBy("seq").collect()] == ["NVDA", "NVDA", "NVDA", "TSLA"]


def test_watchlist_order_decides_between_copies(spark, tmp_path):
    item = {"title": "t", "link": "same"}
    lines = [json.dumps({"ticker": ticker, "item": item}) for ticker in ("AAA", "BBB", "CCC")]
    (tmp_path / "news.json").write_text("\n".join(lines))
    found = op.normalize_news(read_news(spark, str(tmp_path)), as_of(), "bbb,aaa,bbb")
    assert {row.ticker for row in found.collect()} == {"AAA", "BBB"}
    assert [row.ticker for row in op.insert_if_absent(found, found.limit(0)).collect()] == ["BBB"]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc", "json"])
def test_prices(spark, tmp_path, fmt):
    closes = spark.sql("""select * from values (date'2024-01-01','A',1.0D), (date'2024-01-02','A',2.0D),
                          (date'2024-01-03','A',3.0D), (date'2024-01-02','B',9.0D) as t(date, ticker, close)""")
    path = str(tmp_path / fmt)
    writer = closes.write.option("header", True) if fmt == "csv" else closes.write
    writer.format(fmt).save(path)
    got = read_prices(spark, path, ["A", "MISSING"], "2024-01-01", "2024-01-03", fmt)
    assert [(str(d), t, c) for d, t, c in rows(got)] == [("2024-01-01", "A", 1.0), ("2024-01-02", "A", 2.0)]


@pytest.mark.parametrize("small", [True, False])
def test_a_watchlist_can_be_a_table(spark, tmp_path, monkeypatch, small):
    if not small:
        monkeypatch.setattr("tidewire.operators.keyed.fits_broadcast", lambda rows: False)
    watch = spark.range(5_000).selectExpr("concat('X', id) as ticker", "id + 10 as pos").union(
        spark.sql("select * from values (' bbb', 1L), ('AAA', 2L), ('bbb ', 7L), ('', 0L), (null, 3L) as t(ticker, pos)"))
    item = {"title": "t", "link": "same"}
    lines = [json.dumps({"ticker": ticker, "item": item}) for ticker in ("AAA", "BBB", "CCC")]
    (tmp_path / "news.json").write_text("\n".join(lines))
    raw = read_news(spark, str(tmp_path))
    by_table, by_list = op.normalize_news(raw, as_of(), watch), op.normalize_news(raw, as_of(), "bbb,aaa,bbb")
    assert rows(by_table.drop("seq", "rank"), "ticker") == rows(by_list.drop("seq", "rank"), "ticker")
    assert by_table.schema == by_list.schema
    new = op.insert_if_absent(by_table, by_table.limit(0))
    assert [row.ticker for row in new.collect()] == ["BBB"]
    counts = op.insert_counts(new, watch)
    assert counts.count() == 5_002 and rows(counts.where("inserted > 0")) == [("BBB", 1)]
    posts = spark.createDataFrame([(1, "$AAA $CCC $AAA"), (2, "$BBB $AAA"), (3, "none"), (4, None)], "id int, title string")
    assert rows(op.explode_mentions(posts, watch)) == rows(op.explode_mentions(posts, "aaa, bbb"))
    # beyond the measured size there is no hint; Spark's own threshold decides
    assert ("broadcast" in op.explode_mentions(posts, watch)._jdf.queryExecution().analyzed().toString()) == small
