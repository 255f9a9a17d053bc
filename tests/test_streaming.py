import datetime as dt

import pytest
from pyspark.sql import functions as F

from frames import bars, instants
from tapeworks.operators.asof import latest_bars
from tapeworks.operators.windows import session_windows
from tapeworks.sources.calendar import session_calendar
from tapeworks.streaming.windows import stream_session_windows, stream_stories


def drained(spark, query_frame, name, folder):
    run = (
        query_frame.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    return spark.table(name)


def test_streamed_windows_equal_the_batch_ones(spark, tmp_path):
    day = instants(bars(spark, [(570 + 5 * i, 100.0 + i, 101.0, 99.0, 101.0 + i, 10.0 * i) for i in range(14)]))
    early = instants(bars(spark, [(500, 1.0, 1.0, 1.0, 1.0, 1.0)]))  # before the open: not part of any window
    changes = {"close": F.col("close") + 3, "available_ts": F.expr("available_ts + INTERVAL 1 HOUR")}
    newer = day.filter("minute = 580").withColumns(changes)
    source = tmp_path / "bars"
    day.unionByName(early).unionByName(newer).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    calendar = session_calendar(spark, "2024-03-01", "2024-03-31")
    got = drained(spark, stream_session_windows(stream, calendar), "windows", tmp_path / "c1").collect()
    rows = latest_bars(day.unionByName(newer))
    timed = rows.withColumns({"open_min": F.lit(570), "close_min": F.lit(660)})
    want = session_windows(timed, timed.select("ticker", "date", "open_min", "close_min").distinct()).filter("n_subbars > 0").orderBy("slot").collect()
    got = sorted(got, key=lambda r: r["window_start"])
    assert len(got) == 3  # two windows are still open behind the watermark
    for a, b in zip(got, want):
        assert a["r_w"] == pytest.approx(b["r_w"]) and a["dollar_vol"] == pytest.approx(b["dollar_vol"]) and a["n_subbars"] == b["n_subbars"]


def test_streamed_stories(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start, "Same"), ("b", start + dt.timedelta(hours=72), "same!"), ("c", start + dt.timedelta(hours=145), "Same"), ("u", start, None), ("v", start, "!"), ("z", start + dt.timedelta(days=60), "Later")]
    source = tmp_path / "news"
    spark.createDataFrame(rows, "article_id string, published_ts timestamp, title string").write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    got = drained(spark, stream_stories(stream), "stories", tmp_path / "c2").collect()
    assert {(r["cluster_id"], r["n_copies"]) for r in got} == {("a", 2), ("c", 1), ("u", 1), ("v", 1)}
