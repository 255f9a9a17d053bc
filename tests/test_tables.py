import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from frames import DAY, bars, instants
from tapeworks.operators import asof
from tapeworks.sources import pages, tables


@pytest.fixture(scope="module")
def stored(spark):
    return instants(bars(spark, [(570 + 5 * i, 10.0, 11.0, 9.0, 10.0 + i, 100.0) for i in range(12)])).cache()


def revision(stored, minute):
    return stored.filter(F.col("minute") == minute).withColumns(
        {"close": F.col("close") + 1, "available_ts": F.expr("available_ts + INTERVAL 2 HOURS")}
    )


def test_append_is_idempotent_and_keeps_revisions(spark, stored, tmp_path):
    path = str(tmp_path / "bars")
    assert tables.append_bars(spark, path, stored.drop("date", "minute")) == 12
    assert tables.append_bars(spark, path, stored.drop("date", "minute")) == 0
    assert tables.append_bars(spark, path, revision(stored, 595).drop("date", "minute")) == 1
    assert spark.read.parquet(path).count() == 13


def test_articles_are_appended_once_whatever_their_date(spark, tmp_path):
    path = str(tmp_path / "news")
    rows = lambda *items: spark.createDataFrame([(i, d, d) for i, d in items], "article_id string, published_ts timestamp, available_ts timestamp")
    assert tables.append_news(spark, path, rows(("x", dt.datetime(2024, 3, 10)), ("y", dt.datetime(2024, 3, 11)))) == 2
    assert tables.append_news(spark, path, rows(("x", dt.datetime(2024, 3, 12)), ("z", dt.datetime(2024, 3, 12)))) == 1
    assert spark.read.parquet(path).count() == 3


def test_an_unreadable_table_is_an_error(spark, stored, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        tables.append_bars(spark, str(tmp_path / "broken"), stored.drop("date", "minute"))


def test_asof_reads_are_pruned_by_date(spark, stored, tmp_path):
    path = str(tmp_path / "bars")
    tables.append_bars(spark, path, stored.drop("date", "minute"))
    table = spark.read.parquet(path).withColumn("minute", F.lit(600))
    read = asof.bars_asof(table, dt.datetime(2024, 3, 18, 15, 0), 600)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert read.count() == 12


def test_range_without_sessions_keeps_its_schema(spark, stored):
    from tapeworks.sources.calendar import session_calendar

    calendar = session_calendar(spark, "2024-03-01", "2024-03-31")
    some = asof.range_bars_asof(stored, calendar, "2024-03-18", "2024-03-18")
    none = asof.range_bars_asof(stored, calendar, "2024-03-16", "2024-03-17")
    assert none.schema == some.schema and none.count() == 0 and some.count() > 0


def test_windows_of_a_universe_alone(spark, stored):
    from tapeworks.operators.windows import build_windows
    from tapeworks.sources.calendar import session_calendar

    calendar = session_calendar(spark, "2024-03-01", "2024-03-31")
    other = stored.withColumn("ticker", F.lit("ZZZ"))
    universe = stored.select("ticker").distinct()
    got = build_windows(stored.unionByName(other), calendar, "2024-03-18", "2024-03-18", universe)
    assert {r["ticker"] for r in got.collect()} == {r["ticker"] for r in universe.collect()} and got.count() == 26


def test_wall_clock_timestamps_are_rejected(stored):
    with pytest.raises(ValueError, match="timezone-aware"):
        tables.new_bars(stored, stored.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz")))


def test_bar_is_visible_only_after_its_latency(spark, stored):
    end = F.lit(dt.datetime(2024, 3, 18, 14, 25)).cast("timestamp")  # 10:25 exchange time, summer clock
    before = asof.bars_asof(stored, end)
    after = asof.bars_asof(stored, F.timestamp_micros(F.unix_micros(end) + 5_000_000))
    assert before.agg(F.max("minute")).first()[0] == 615
    assert after.agg(F.max("minute")).first()[0] == 620


def test_revision_changes_only_later_reads_and_lookback_limits(stored):
    both = stored.unionByName(revision(stored, 595))
    at = lambda h, m: F.lit(dt.datetime(2024, 3, 18, h, m)).cast("timestamp")
    close = lambda df: df.filter("minute = 595").first()["close"]
    assert close(asof.bars_asof(both, at(15, 0))) == 15.0
    assert close(asof.bars_asof(both, at(17, 0))) == 16.0
    assert asof.bars_asof(both, at(15, 0), 90).agg(F.min("minute")).first()[0] == 570


def test_appending_later_rows_never_changes_a_past_read(stored):
    moment = F.lit(dt.datetime(2024, 3, 18, 14, 0)).cast("timestamp")
    early = asof.bars_asof(stored.filter("minute < 600"), moment)
    late = asof.bars_asof(stored.unionByName(revision(stored, 570)), moment)
    assert sorted(map(str, early.collect())) == sorted(map(str, late.collect()))


def test_pages_of_bars_are_combined(spark, tmp_path):
    first = {"ticker": "AAA", "results": [
        {"t": 1710768600000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10, "n": 3, "vw": 1.2},
        {"t": 1710768900000, "o": 1.5, "h": 2, "l": 1, "c": 1.8, "v": 5, "n": 2},
    ], "next_url": "page-2"}
    second = {"ticker": "AAA", "results": [{"t": 1710769200000, "o": 1.8, "h": 2, "l": 1, "c": 1.9, "v": 7, "n": 2, "vw": 1.9}]}
    for name, page in (("a", first), ("b", second), ("c", {"ticker": "BBB"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(page))
    rows = pages.read_bar_pages(spark, str(tmp_path)).orderBy("event_ts").collect()
    assert [r["close"] for r in rows] == [1.5, 1.8, 1.9]
    assert rows[1]["vwap"] is None and rows[0]["open"] == 1.0
    assert (rows[0]["available_ts"] - rows[0]["event_ts"]).total_seconds() == 305


def test_news_page_full_and_minimal(spark):
    full = {"results": [{
        "id": "x", "published_utc": "2024-03-18T12:00:00Z", "publisher": {"name": "Wire"}, "title": "t", "description": "d",
        "keywords": ["k"], "tickers": ["AAA", "BBB"],
        "insights": [{"ticker": "AAA", "sentiment": "neutral"}, {"ticker": "AAA", "sentiment": "positive", "sentiment_reasoning": "r"}],
    }]}
    minimal = {"results": [{"id": "y", "published_utc": "2024-03-18T13:00:00", "tickers": ["AAA"]}]}
    payloads = spark.createDataFrame([(json.dumps(full),), (json.dumps(minimal),)], "payload string")
    articles = pages.articles_from_pages(pages.parse_payloads(payloads, pages.NEWS_PAGE))
    tags = {(r["article_id"], r["ticker"]): r["sentiment"] for r in pages.article_tags(articles).collect()}
    assert tags == {("x", "AAA"): "positive", ("x", "BBB"): None, ("y", "AAA"): None}
    got = {r["article_id"]: r for r in articles.collect()}
    assert got["y"]["keywords"] == [] and got["y"]["publisher"] is None
    assert (got["x"]["available_ts"] - got["x"]["published_ts"]).total_seconds() == 900


def test_append_news_by_range(spark, tmp_path):
    payload = json.dumps({"results": [{"id": str(i), "published_utc": f"2024-03-{10 + i}T12:00:00Z"} for i in range(4)]})
    articles = pages.articles_from_pages(pages.parse_payloads(spark.createDataFrame([(payload,)], "payload string"), pages.NEWS_PAGE))
    path = str(tmp_path / "news")
    assert tables.append_news(spark, path, articles, "2024-03-11", "2024-03-13") == 2
    assert tables.append_news(spark, path, articles) == 2
    assert tables.append_news(spark, path, articles) == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("AAA", DAY, 580, 0.1), ("BBB", DAY, 575, 0.2)], "ticker string, date date, minute int, net_ret double")
    tables.write_trades(rows, str(tmp_path / "trades"))
    back = spark.read.option("header", True).csv(str(tmp_path / "trades"))
    assert back.count() == 2 and set(back.columns) == set(rows.columns)
    from tapeworks.config import CostModel
    from tapeworks.plans.records import experiment_record

    bounds = spark.createDataFrame([(0, DAY, DAY)], "fold_id int, train_from date, test_to date")
    metrics = spark.createDataFrame([(0, 0.5)], "fold_id int, hit double")
    for _ in range(2):
        tables.record_experiment(experiment_record("e", bounds, metrics, ("hit",), {"costs": CostModel()}), str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 2 and json.loads(log.first()["config"])["costs"]["spread_bps"] == 5.0
