import datetime as dt
import json
import os

import pytest
from frames import rows
from pyspark.sql import functions as F

from tidewire import operators as op
from tidewire.plans import RunConfig, dashboard_tables, run_end_to_end
from tidewire.schemas import LEXICON, PRICES
from tidewire.session import local_frame, shared_dir
from tidewire.sources import read_headlines, read_scores
from tidewire.sources.tables import MOST_FOLDERS, _partials, _width, add_daily_partials, read_daily_partials, replace_daily_partials
from tidewire.streaming import daily_partials_stream, daily_stream, ingest, ingest_stream, stored_daily

GOOD, BAD = "good news today", "bad news today"


def lexicon(spark):
    return local_frame(spark, [("good", 2.0), ("bad", -2.0)], LEXICON)


def news_line(ticker, n, good, link=None):
    item = {"title": GOOD if good else BAD, "link": link or f"https://n/{ticker}/{n}", "pubDate": f"2024-01-0{n + 1}T14:00:00Z"}
    return json.dumps({"ticker": ticker, "item": item})


@pytest.fixture
def landed(spark, tmp_path):
    news, forum, prices = tmp_path / "news", tmp_path / "forum", tmp_path / "prices"
    news.mkdir(), forum.mkdir()
    lines = [news_line(ticker, n, (n + (ticker == "TSLA")) % 2) for ticker in ("nvda", "tsla") for n in range(8)]
    lines += [lines[0], news_line("other", 0, True), "broken"]
    (news / "1.json").write_text("\n".join(lines))
    posts = [{"title": f"$NVDA $TSLA {GOOD}", "url": "https://f/1", "created_utc": 1704067200}, {"title": "no ticker", "url": "x"}]
    (forum / "1.json").write_text(json.dumps({"data": {"children": [{"data": post} for post in posts]}}))
    data = [(dt.date(2024, 1, 1 + n), ticker, 100.0 + 3 * n * (-1) ** n) for ticker in ("NVDA", "TSLA", "ZZZ") for n in range(10)]
    local_frame(spark, data, PRICES).write.parquet(str(prices))
    return RunConfig(
        news_path=str(news), forum_path=str(forum), prices_path=str(prices), store=str(tmp_path / "store"),
        watch="nvda, tsla, spy", as_of="2024-02-01", backend="vader", score_options={"lexicon": lexicon(spark)},
    )


def test_run_twice(spark, landed):
    first = run_end_to_end(spark, landed)
    assert dict(rows(first["inserted"])) == {"NVDA": 9, "TSLA": 8, "SPY": 0}
    assert rows(first["scored"]) == [(17,)]
    assert rows(first["rejected"]) == [("news", 19, 1)]
    assert first["wide"].columns == ["date", "NVDA", "TSLA"] and first["wide"].count() == 8
    metrics = first["metrics"].first()
    # Eight days of sentiment, but the first day of prices has no return, so no row to meet.
    assert metrics.n_days == 7 and metrics.cumulative_return is not None
    assert {row.ticker for row in first["aligned"].collect()} == {"NVDA", "TSLA"}
    again = run_end_to_end(spark, landed)
    assert dict(rows(again["inserted"])) == {"NVDA": 0, "TSLA": 0, "SPY": 0}
    assert rows(again["scored"]) == [(0,)]
    assert again["metrics"].first() == metrics
    assert read_scores(spark, f"{landed.store}/scores").count() == 17


def test_run_without_forum_or_history(spark, landed, tmp_path):
    config = RunConfig(**{**landed.__dict__, "forum_path": str(tmp_path / "nowhere"), "store": str(tmp_path / "s2"), "min_days": 20})
    result = run_end_to_end(spark, config)
    assert dict(rows(result["inserted"]))["NVDA"] == 8
    assert tuple(result["metrics"].first()) == (None, None, None, 0)


def test_backtest_window(spark, landed, tmp_path):
    config = RunConfig(**{**landed.__dict__, "store": str(tmp_path / "s3"), "start": "2024-01-03", "end": "2024-01-07"})
    result = run_end_to_end(spark, config)
    assert [str(row.date) for row in result["equity"].collect()] == ["2024-01-04", "2024-01-05"]


def test_dashboard(spark, landed):
    run_end_to_end(spark, landed)
    scored = op.scored_frame(read_headlines(spark, f"{landed.store}/headlines"), read_scores(spark, f"{landed.store}/scores"))
    prices = spark.read.parquet(landed.prices_path)
    tables = dashboard_tables(scored, prices)
    assert rows(tables["tickers"]) == [("NVDA",), ("TSLA",)]
    assert tables["feed"].count() == 17 and tables["metrics"].first().n_days == 7
    one = dashboard_tables(scored, prices, ["TSLA"])
    assert {row.ticker for row in one["daily"].collect()} == {"TSLA"} and one["equity"].count() == 7
    everything = dashboard_tables(scored, prices, [])
    assert everything["feed"].count() == 17 and "metrics" not in everything


def test_stream_ingest_replay_and_scoring(spark, landed, tmp_path):
    store = str(tmp_path / "streamed")
    now = F.lit("2024-02-01").cast("timestamp")

    def run(checkpoint, **options):
        ingest_stream(spark, landed.news_path, store, str(tmp_path / checkpoint), now, watch=landed.watch,
                      score_backend="vader", lexicon=lexicon(spark), **options).awaitTermination()

    run("c1")
    assert read_headlines(spark, f"{store}/headlines").count() == 16
    (tmp_path / "news" / "2.json").write_text("\n".join([news_line("nvda", 0, False), news_line("nvda", 8, True)]))
    run("c1")
    assert read_headlines(spark, f"{store}/headlines").count() == 17
    run("c2")  # the checkpoint is lost: all files again, nothing new
    headlines, scores = read_headlines(spark, f"{store}/headlines"), read_scores(spark, f"{store}/scores")
    assert headlines.count() == 17 and scores.count() == 17
    ingest_stream(spark, landed.forum_path, store, str(tmp_path / "c3"), now, kind="forum", watch=landed.watch).awaitTermination()
    assert read_headlines(spark, f"{store}/headlines").where("source = 'reddit'").count() == 1
    batch = op.daily_sentiment(op.scored_frame(headlines, scores))
    direct = run_end_to_end(spark, RunConfig(**{**landed.__dict__, "forum_path": None, "store": str(tmp_path / "b")}))["daily"]
    assert rows(direct) == rows(batch)


def test_stream_daily_equals_batch_on_closed_days(spark, tmp_path):
    data = [("A", f"u{n % 50}", "s", dt.datetime(2024, 1, 1 + n // 10, n % 10, tzinfo=dt.timezone.utc), n / 100, 0.5) for n in range(60)]
    schema = "ticker string, url string, source string, published_at timestamp, score double, confidence double"
    frame = local_frame(spark, [row for row in data if row[1] != "u3"] , schema)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = daily_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    query.start(str(tmp_path / "out")).awaitTermination()
    closed = rows(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")))
    unique = frame.dropDuplicates(["source", "url"])
    batch = [row for row in rows(op.daily_sentiment(unique)) if row[1] < dt.date(2024, 1, 5)]
    assert len(closed) >= 4 and [row[:2] for row in closed[:4]] == [row[:2] for row in batch[:4]]
    for got, want in zip(closed[:4], batch[:4]):
        assert got[3] == want[3] and got[2] == pytest.approx(want[2])


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_earlier_results_stay(spark, landed):
    first = run_end_to_end(spark, landed)
    before = rows(first["daily"]), rows(first["equity"])
    run_end_to_end(spark, landed)
    assert (rows(first["daily"]), rows(first["equity"])) == before


def test_many_watched_tickers(spark, landed, tmp_path):
    names = [f"T{n}" for n in range(12_000)]
    config = RunConfig(**{**landed.__dict__, "store": str(tmp_path / "many"), "watch": ["NVDA", *names]})
    result = run_end_to_end(spark, config)
    assert result["inserted"].count() == 12_001 and result["inserted"].where("inserted > 0").count() == 1
    assert result["wide"].columns == ["date", "NVDA"]


def test_partials_add_up(spark, tmp_path):
    data = [("A" if n % 3 else None, f"u{n}", "s", dt.datetime(2024, 1, 1 + n * 7 % 5, n % 24, tzinfo=dt.timezone.utc),
             float("nan") if n % 11 == 0 else n / 64, None if n % 2 else 0.5) for n in range(60)]
    schema = "ticker string, url string, source string, published_at timestamp, score double, confidence double"
    frame = local_frame(spark, data, schema)
    for part in range(3):  # late rows too: days are spread over all files
        frame.where(F.hash("url") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        daily_partials_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    frame = frame.where(F.hash("url") % 3 >= 0)
    assert rows(stored_daily(spark, str(tmp_path / "out"))) == [(a, b, pytest.approx(c), d, e) for a, b, c, d, e in rows(op.daily_sentiment(frame))]


def test_a_batch_reads_its_own_keys_only(spark, landed, tmp_path, monkeypatch):
    store, now = str(tmp_path / "keyed"), F.lit("2024-02-01").cast("timestamp")

    def run(checkpoint):
        ingest_stream(spark, landed.news_path, store, str(tmp_path / checkpoint), now, watch=landed.watch).awaitTermination()
        return read_headlines(spark, f"{store}/headlines").count()

    def no_scan(*args):
        raise AssertionError("the stored headlines were read")

    with monkeypatch.context() as patched:
        patched.setattr(ingest, "read_headlines", no_scan)
        assert run("k1") == 16
        (tmp_path / "news" / "2.json").write_text("\n".join([news_line("nvda", 0, False), news_line("nvda", 8, True)]))
        assert run("k1") == 17
        assert run("k2") == 17  # a new checkpoint learns the keys from the store's files

    # a batch that was stored, but fell before it was noted, is compared with the store when it runs again
    (tmp_path / "news" / "3.json").write_text(news_line("tsla", 8, True))
    store_new = ingest.store_new

    def fall(*args, **options):
        store_new(*args, **options)
        raise RuntimeError("fell")

    with monkeypatch.context() as patched:
        patched.setattr(ingest, "store_new", fall)
        with pytest.raises(Exception, match="fell"):
            run("k2")
    assert run("k2") == 18


def test_a_day_has_one_file(spark, tmp_path):
    path, truth = str(tmp_path / "days"), []
    for batch in range(6):
        data = [("AB"[n % 2], "s", f"{batch}-{n}", dt.datetime(2024, 1, 1 + (n + batch) % 3, 5, tzinfo=dt.timezone.utc), n / 8, 0.5) for n in range(8)]
        truth += data
        frame = local_frame(spark, data, "ticker string, source string, url string, published_at timestamp, score double, confidence double")
        add_daily_partials(op.daily_partials(frame), path, batch)
    add_daily_partials(op.daily_partials(frame), path, 5)  # the last batch again
    everything = local_frame(spark, truth, "ticker string, source string, url string, published_at timestamp, score double, confidence double")
    assert rows(stored_daily(spark, path)) == rows(op.daily_sentiment(everything).select("ticker", "date", "sentiment", "n", "confidence"))
    days = sorted(name for name in os.listdir(path) if name.startswith("date="))
    assert days == ["date=2024-01-01", "date=2024-01-02", "date=2024-01-03"]
    before = {day: os.listdir(f"{path}/{day}") for day in days}
    assert all(sum(name.endswith(".parquet") for name in files) == 1 for files in before.values())
    add_daily_partials(op.daily_partials(frame.where("day(published_at) = 2")), path, 6)
    assert {day for day in days if os.listdir(f"{path}/{day}") != before[day]} == {"date=2024-01-02"}


def test_daily_partials_that_lack_rows_are_made_anew(spark, landed, tmp_path):
    first = run_end_to_end(spark, landed)
    before = rows(first["daily"])
    replace_daily_partials(read_daily_partials(spark, f"{landed.store}/daily").where("ticker = 'NVDA'").drop("applied"), f"{landed.store}/daily")
    assert rows(run_end_to_end(spark, landed)["daily"]) == before


def test_many_days_share_folders(spark, tmp_path):
    path = str(tmp_path / "centuries")
    days = spark.range(-3_000, 3_000).selectExpr("'A' as ticker", "date_from_unix_date(cast(id as int) * 7) as date", "1.0D as score_sum", "1L as score_n",
                                                "0.5D as confidence_sum", "1L as confidence_n", "1L as n")

    def files():
        return set(_partials(spark, path, _width(spark, path)).inputFiles())

    def folders():
        return {name.rpartition("/")[0] for name in files()}

    some = days.where("abs(unix_date(date)) < 700")
    add_daily_partials(some, path, 0)
    assert len(folders()) == 199 and all("/date=" in name for name in folders())
    add_daily_partials(days, path, 1)
    add_daily_partials(days, path, 1)  # the same batch again
    assert 10 <= len(folders()) <= MOST_FOLDERS and len(folders()) == len(files())
    late = days.where("date = '1970-01-01'")
    before = files()
    add_daily_partials(late, path, 2)
    assert len(before - files()) == 1
    stored = read_daily_partials(spark, path).collect()
    assert len(stored) == 6_000 and sum(row["n"] for row in stored) == 6_000 + 199 + 1
    assert {row["n"] for row in stored if abs((row["date"] - dt.date(1970, 1, 1)).days) >= 700} == {1}
    replace_daily_partials(read_daily_partials(spark, path).where("date >= '1970-01-01'").drop("applied"), path)
    assert read_daily_partials(spark, path).count() == 3_000
