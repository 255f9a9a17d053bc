import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from frames import DAY, bars, instants
from tapeworks.functions.scalars import nan_to_null
from tapeworks.operators import intraday, premarket
from tapeworks.operators.trend import next_day_target, trend_features

N_DAYS = 26


def walk(spark, tickers=("AAA", "SPY"), days=N_DAYS, seed=7):
    """Random-walk bars on consecutive dates: four pre-market and 20 regular bars a day."""
    rng, rows = random.Random(seed), []
    for ticker in tickers:
        price = 100.0
        for i in range(days):
            day = dt.date(2024, 1, 2) + dt.timedelta(days=i)
            for minute in (480, 500, 525, 535, *range(570, 670, 5)):
                new = price * math.exp(rng.gauss(0, 0.004))
                high, low = max(price, new) * 1.001, min(price, new) * 0.999
                rows.append((ticker, day, minute, price, high, low, new, float(rng.randint(100, 900))))
                price = new
    return instants(spark.createDataFrame(rows, "ticker string, date date, minute int, open double, high double, low double, close double, volume double"))


@pytest.fixture(scope="module")
def tape(spark):
    return walk(spark).cache()


@pytest.fixture(scope="module")
def calendar(spark):
    days = spark.range(N_DAYS).select(F.date_add(F.lit("2024-01-02").cast("date"), F.col("id").cast("int")).alias("date"))
    return days.withColumns({"open_min": F.lit(570), "close_min": F.lit(960)})


def regular(tape):
    return tape.filter("minute >= 570").withColumns({"open_min": F.lit(570), "close_min": F.lit(960)})


def keyed(df, *columns):
    return {(r["ticker"], r["date"], r["minute"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_forward_return_enters_next_open_and_leaves_three_bars_on(spark):
    rows = bars(spark, [(570 + 5 * i, 100.0 + i, 0.0, 0.0, 200.0 + i, 1.0) for i in range(6)])
    got = keyed(intraday.forward_return(rows), "fwd_ret_15m")
    assert got[("AAA", DAY, 570)][0] == pytest.approx(math.log(203 / 101))
    assert [got[("AAA", DAY, 570 + 5 * i)][0] for i in (3, 4, 5)] == [None, None, None]


def test_partial_windows_are_unknown_and_zero_volume_is_no_divisor(tape, spark):
    got = keyed(intraday.session_features(regular(tape)), "rv30", "rv60", "vol_ratio", "minutes_since_open", "minutes_to_close")
    day = dt.date(2024, 1, 5)
    known = [[got[("AAA", day, 570 + 5 * i)][c] is not None for i in range(20)] for c in range(3)]
    assert [k.index(True) for k in known] == [6, 12, 11]
    assert got[("AAA", day, 575)][3:] == (5.0, 385.0)
    flat = bars(spark, [(570, 1.0, 1.0, 1.0, 1.0, 0.0), (575, 1.0, 1.0, 1.0, 1.0, 5.0)])
    assert keyed(intraday.volume_shape(flat), "vol_accel")[("AAA", DAY, 575)] == (None,)


@pytest.mark.parametrize("cut", [15, 25])
def test_bar_features_do_not_change_when_the_future_is_cut(tape, cut):
    names = [c for c in intraday.PRICE_FEATURES if not c.startswith("qqq")]
    last = dt.date(2024, 1, 2) + dt.timedelta(days=cut)
    part = tape.filter((F.col("date") < F.lit(last)) | ((F.col("date") == F.lit(last)) & (F.col("minute") <= 610)))
    full, seen = (keyed(intraday.build_price_features(regular(t)), *names) for t in (tape, part))
    assert seen and all(full[k] == pytest.approx(v, rel=1e-9, nan_ok=True) for k, v in seen.items() if None not in v)
    assert all(full[k] == v for k, v in seen.items() if None in v) or all(
        a == b or a == pytest.approx(b, rel=1e-9) for k, v in seen.items() for a, b in zip(full[k], v)
    )


def test_snapshot_ignores_everything_after_the_cutoff(tape, calendar):
    last = dt.date(2024, 1, 2) + dt.timedelta(days=N_DAYS - 1)
    moved = tape.withColumns(
        {c: F.when((F.col("date") == F.lit(last)) & (F.col("minute") >= 535), F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")}
    )
    a, b = (
        {(r["ticker"], r["date"]): r.asDict() for r in premarket.build_snapshot_features(t, calendar).collect()}
        for t in (tape, moved)
    )
    row, again = a[("AAA", last)], b[("AAA", last)]
    assert row["n_pm_bars"] == 3 and row["vol20"] is not None and row["pm_vol_ratio"] is not None
    assert {k: v for k, v in row.items()} == {k: v for k, v in again.items()}
    assert a[("AAA", dt.date(2024, 1, 2))]["gap"] is None
    assert row["rel_gap"] == pytest.approx(row["gap"] - row["spy_gap"])


def test_snapshot_against_plain_arithmetic(tape, calendar):
    rows = [r for r in tape.orderBy("date", "minute").collect() if r["ticker"] == "AAA"]
    by_day = {}
    for r in rows:
        by_day.setdefault(r["date"], []).append(r)
    days = sorted(by_day)
    closes = [[r for r in by_day[d] if r["minute"] >= 570][-1]["close"] for d in days]
    rets = [None] + [math.log(b / a) for a, b in zip(closes, closes[1:])]
    got = {r["date"]: r for r in premarket.build_snapshot_features(tape, calendar).filter("ticker = 'AAA'").collect()}
    i = 23
    window = rets[i - 20 : i]
    mean = sum(window) / 20
    assert got[days[i]]["vol20"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in window) / 19))
    pm = [sum(r["close"] * r["volume"] for r in by_day[d] if r["minute"] < 535) for d in days]
    past = sorted(pm[i - 20 : i])
    assert got[days[i]]["pm_vol_ratio"] == pytest.approx(pm[i] / ((past[9] + past[10]) / 2))
    assert got[days[2]]["vol5"] is None and got[days[4]]["vol5"] is not None


def test_trend_features(spark):
    closes = [1.0, 2.0, 1.5, 3.0, 4.0]
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 1 + i), c) for i, c in enumerate(closes)], "ticker string, date date, close double")
    got = trend_features(next_day_target(rows), (2,)).orderBy("date").collect()
    assert [r["target"] for r in got] == [1, 0, 1, 1, 0]
    assert [r["close_ratio_2"] for r in got] == pytest.approx([None, 2 / 1.5, 1.5 / 1.75, 3 / 2.25, 4 / 3.5])
    assert [r["trend_2"] for r in got] == [None, None, 1.0, 1.0, 2.0]


def test_nan_becomes_null(spark):
    rows = nan_to_null(spark.createDataFrame([(float("nan"), "x"), (1.0, "y")], "v double, k string"))
    assert {r["k"]: r["v"] for r in rows.collect()} == {"x": None, "y": 1.0}
