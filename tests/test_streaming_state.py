"""Stateful streams against their batch forms, over shuffled and repeated micro-batches."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from frames import bars, instants
from tapeworks.operators.asof import bars_asof
from tapeworks.operators.trades import thin_events
from tapeworks.sources import tables
from tapeworks.streaming import ingest
from tapeworks.streaming.trades import ROCKS, stream_thin_events

DECIDED = "ticker string, date date, minute int, decision string, fwd_ret_15m double, q10 double"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_streamed_trades_equal_the_batch_ones(rocks, tmp_path):
    spark, rng = rocks, random.Random(4)
    rows = []
    for ticker in "AB":
        for day in (18, 19):
            for minute in range(570, 960, 5):
                decision = rng.choice(["long", "short", "hold"])
                rows.append((ticker, dt.date(2024, 3, day), minute, decision, rng.gauss(0, 0.01) if rng.random() < 0.9 else None, rng.choice([None, -0.01])))
    want = thin_events(spark.createDataFrame(rows, DECIDED)).collect()
    rng.shuffle(rows)
    rows += rows[:40]  # bars that arrive twice
    folder = tmp_path / "decided"
    for i in range(0, len(rows), 80):
        spark.createDataFrame(rows[i : i + 80], DECIDED).coalesce(1).write.mode("append").parquet(str(folder))
    late = [("Z", dt.date(2024, 3, 27), 600, "long", 0.0, None)]
    stream = spark.readStream.schema(DECIDED).option("maxFilesPerTrigger", 1).parquet(str(folder))
    checkpoint = str(tmp_path / "c")

    def run():
        query = (
            stream_thin_events(stream, delay="3 days").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination(200)
        assert query.exception() is None

    run()
    spark.createDataFrame(late, DECIDED).coalesce(1).write.mode("append").parquet(str(folder))
    run()  # the state of the first run goes on
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    key = lambda r: (r["ticker"], r["date"], r["minute"], r["direction"], round(r["gross_ret"], 9), round(r["net_ret"], 9), r["q10"] is None)
    assert len(want) > 40 and sorted(map(key, got)) == sorted(map(key, want))


def page(ticker, minutes, close):
    start = int(dt.datetime(2024, 3, 18, tzinfo=dt.timezone.utc).timestamp() * 1000)
    item = lambda m: {"t": start + m * 60_000, "o": 1.0, "h": 2.0, "l": 0.5, "c": close, "v": 10.0, "n": 3, "vw": 1.1}
    return json.dumps({"ticker": ticker, "results": [item(m) for m in minutes]})


def test_arriving_pages_are_stored_once(spark, tmp_path):
    landing, path, checkpoint = tmp_path / "landing", str(tmp_path / "bars"), str(tmp_path / "c")
    landing.mkdir()

    def run():
        query = ingest.ingest_bars(ingest.arriving_pages(spark, str(landing), files_at_once=1), path, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None

    (landing / "1.json").write_text(page("A", range(840, 900, 5), 1.0))
    (landing / "2.json").write_text(page("A", range(870, 930, 5), 1.0))  # half of it again
    run()
    assert spark.read.parquet(path).count() == 18
    (landing / "3.json").write_text(page("B", range(840, 900, 5), 1.0))
    run()
    got = spark.read.parquet(path)
    assert got.count() == 30
    batch = tables.new_rows(got.limit(0), got, tables.BAR_KEY)
    assert batch.count() == 30
    ledger = spark.read.parquet(f"{checkpoint}/ledger")
    assert ledger.agg(F.sum("rows")).first()[0] == 30


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    """The same batch twice, and once more with the ledger's entry lost."""
    path, ledger = str(tmp_path / "bars"), str(tmp_path / "ledger")
    rows = instants(bars(spark, [(570 + 5 * i, 10.0, 11.0, 9.0, 10.0 + i, 100.0) for i in range(12)])).drop("date", "minute")
    run = ingest._once(tables.append_bars, path, ledger)
    run(rows, 0)
    run(rows, 0)
    assert spark.read.parquet(ledger).count() == 1 and spark.read.parquet(path).count() == 12
    ingest._once(tables.append_bars, path, str(tmp_path / "lost"))(rows, 0)
    assert spark.read.parquet(path).count() == 12


def test_revisions_arrive_as_versions(spark, tmp_path):
    path, ledger = str(tmp_path / "bars"), str(tmp_path / "ledger")
    rows = instants(bars(spark, [(570 + 5 * i, 10.0, 11.0, 9.0, 10.0 + i, 100.0) for i in range(12)]))
    newer = rows.filter("minute = 600").withColumns({"close": F.col("close") + 1, "available_ts": F.expr("available_ts + INTERVAL 2 HOURS")})
    run = ingest._once(tables.append_bars, path, ledger)
    for i, batch in enumerate((rows, newer, newer)):
        run(batch.drop("date", "minute"), i)
    stored = spark.read.parquet(path).withColumn("minute", F.lit(600))
    assert stored.count() == 13
    old, new = dt.datetime(2024, 3, 18, 14, 30), dt.datetime(2024, 3, 18, 20, 0)
    total = lambda at: bars_asof(stored, at).agg(F.sum("close")).first()[0]
    assert total(new) == total(old) + sum(r["close"] for r in rows.filter("minute >= 625").collect()) + 1


def test_articles_are_stored_once_by_id(spark, tmp_path):
    path, ledger = str(tmp_path / "news"), str(tmp_path / "ledger")
    rows = lambda *items: spark.createDataFrame([(i, d, d) for i, d in items], "article_id string, published_ts timestamp, available_ts timestamp")
    run = ingest._once(tables.append_news, path, ledger)
    run(rows(("x", dt.datetime(2024, 3, 10)), ("y", dt.datetime(2024, 3, 11))), 0)
    run(rows(("x", dt.datetime(2024, 3, 12)), ("z", dt.datetime(2024, 3, 12))), 1)
    assert spark.read.parquet(path).count() == 3 and {r["rows"] for r in spark.read.parquet(ledger).collect()} == {2, 1}
