import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.clock import exchange_instant, premarket_usable, with_et
from tapeworks.sources import calendar as cal


@pytest.fixture(scope="module")
def year(spark):
    return cal.session_calendar(spark, "2024-01-01", "2024-12-31")


def dates(spark, *days):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "date date")


def test_sessions_per_year_match_the_published_counts(spark):
    rows = cal.session_calendar(spark).groupBy(F.year("date").alias("y")).count().collect()
    counts = {r["y"]: r["count"] for r in rows}
    assert [counts[y] for y in range(2015, 2026)] == [252, 252, 251, 251, 252, 253, 252, 251, 250, 252, 250]


def test_holiday_weekend_and_half_day(spark, year):
    flags = cal.is_session(dates(spark, "2024-07-04", "2024-07-06", "2024-07-05"), year)
    assert {str(r["date"]): r["is_session"] for r in flags.collect()} == {
        "2024-07-04": False, "2024-07-06": False, "2024-07-05": True,
    }
    assert year.filter("date = '2024-07-03'").first()["close_min"] == 13 * 60


def test_open_keeps_exchange_time_across_the_clock_change(year):
    hours = {str(r["date"]): r["h"] for r in year.select("date", F.hour("open_ts").alias("h")).collect()}
    assert hours["2024-01-16"] == 14 and hours["2024-06-17"] == 13


def test_next_session_skips_weekend_and_holiday(spark, year):
    got = cal.next_session(dates(spark, "2024-07-03", "2024-03-22", "2024-12-31"), year)
    assert {str(r["date"]): str(r["next_session"]) for r in got.collect()} == {
        "2024-07-03": "2024-07-05", "2024-03-22": "2024-03-25", "2024-12-31": "None",
    }


def test_cutoff_fails_on_a_day_without_session(spark, year):
    cal.premarket_cutoff(dates(spark, "2024-03-20"), year).collect()
    with pytest.raises(Exception, match="not a trading session"):
        cal.premarket_cutoff(dates(spark, "2024-07-04"), year).collect()


def test_premarket_bar_must_have_arrived_by_the_cutoff(spark):
    rows = spark.createDataFrame([(235,), (240,), (530,), (535,)], "minute int")
    kept = rows.filter(premarket_usable(540, 240, 5)).collect()
    assert sorted(r["minute"] for r in kept) == [240, 530]


def test_with_et_inverts_exchange_instant(spark):
    rows = dates(spark, "2024-03-08", "2024-03-11", "2024-11-04").withColumn("m", F.lit(575))
    back = with_et(rows.select("date", "m", exchange_instant(F.col("date"), F.col("m")).alias("event_ts")).withColumnRenamed("date", "d"))
    assert all(r["d"] == r["date"] and r["minute"] == 575 and r["slot"] == 570 for r in back.collect())


def test_next_session_far_from_the_calendar(spark):
    calendar = cal.session_calendar(spark, "2024-01-01", "2024-01-31")
    dates = ["2023-11-01", "2023-12-31", "2024-01-01", "2024-01-02", "2024-01-06", "2024-01-31", "2025-01-01"]
    rows = spark.createDataFrame([(d,) for d in dates] * 2, "d string").selectExpr("cast(d as date) AS date")
    got = {(str(r["date"]), str(r["next_session"])) for r in cal.next_session(rows, calendar).collect()}
    assert got == set(zip(dates, ["2024-01-02"] * 3 + ["2024-01-03", "2024-01-08", "None", "None"]))
