from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalog.fixtures import BREAKOUT, Fixture
from frames import DAY, PRIOR, bars
from tapeworks.config import BreakoutConfig, CostModel, SweepConfig
from tapeworks.operators import breakout as orb
from tapeworks.operators import sweep as swp
from tapeworks.operators.intraday import overnight_gaps, with_overnight_gap
from tapeworks.operators.sweep_stats import strategy_stats
from tapeworks.runtime import configure

RANGE = [(570, 100.0, 101.0, 99.0, 100.0, 1000.0), (575, 100.0, 101.0, 99.0, 100.0, 1000.0), (580, 100.0, 101.0, 99.0, 100.0, 1000.0)]
LONG = (585, 100.0, 103.0, 100.0, 102.5, 5000.0)


def trades(spark, rows, config=BreakoutConfig(), atr=2.0):
    frame = bars(spark, rows)
    scale = spark.createDataFrame([("AAA", DAY, atr)], "ticker string, date date, atr double")
    return orb.breakout_trades(orb.breakout_signals(frame, config, scale), frame, config, CostModel()).collect()


@pytest.mark.parametrize(
    "later, reason, exit_px, minute",
    [
        ([(590, 103.0, 108.0, 102.0, 107.0, 1.0)], "target", 105.0, 590),
        ([(590, 103.0, 106.0, 100.0, 104.0, 1.0)], "stop", 101.0, 590),
        ([(590, 103.0, 103.5, 102.0, 103.0, 1.0), (595, 103.0, 103.5, 102.0, 103.2, 1.0)], "time", 103.2, 595),
        ([(590, 103.0, 103.5, 102.0, 103.0, 1.0), (595, 107.0, 108.0, 106.0, 107.0, 1.0)], "time", 107.0, 595),  # gapped past, never spanned
    ],
)
def test_exits(spark, later, reason, exit_px, minute):
    (t,) = trades(spark, RANGE + [LONG] + later)
    assert (t["exit_reason"], t["exit"], t["exit_minute"], t["entry"], t["direction"]) == (reason, exit_px, minute, 103.0, "long")
    assert t["net_ret"] == pytest.approx((exit_px - 103) / 103 - 0.0011) and t["q10"] == pytest.approx(-2 / 103)


def test_short_and_boundary_stop(spark):
    rows = RANGE + [(585, 100.0, 100.0, 96.0, 96.5, 5000.0), (590, 96.0, 96.0, 90.0, 92.0, 1.0)]
    (t,) = trades(spark, rows)
    assert (t["direction"], t["exit"]) == ("short", 94.0) and t["gross_ret"] == pytest.approx(2 / 96)
    (b,) = trades(spark, rows, BreakoutConfig(stop_mode="boundary"))
    assert b["stop"] == 101.0 and b["target"] == 91.0


@pytest.mark.parametrize(
    "rows, atr",
    [
        (RANGE + [(585, 100.0, 103.0, 100.0, 102.5, None), (590, 103.0, 108.0, 102.0, 100.0, 1.0)], 2.0),  # unknown volume
        ([(570, 100.0, None, 99.0, 100.0, 1000.0)] + RANGE[1:] + [LONG, (590, 103.0, 108.0, 102.0, 107.0, 1.0)], 2.0),  # unknown range
        (RANGE + [LONG, (590, None, 106.0, 102.0, 105.0, 1.0)], 2.0),  # unknown entry
        (RANGE + [LONG, (590, 103.0, 103.5, 102.0, None, 1.0)], 2.0),  # cannot close
        (RANGE + [LONG], 2.0),  # no bar left to enter
        (RANGE + [LONG, (590, 103.0, 108.0, 102.0, 107.0, 1.0)], None),  # no scale
        (RANGE + [(585, 100.0, 103.0, 100.0, 102.5, 10.0), (590, 103.0, 108.0, 102.0, 100.0, 1.0)], 2.0),  # thin volume
        (RANGE + [(585, 100.0, 101.2, 100.0, 101.1, 5000.0), (590, 101.0, 101.1, 100.0, 101.0, 1.0)], 2.0),  # break too small
    ],
)
def test_sessions_that_do_not_trade(spark, rows, atr):
    assert trades(spark, rows, atr=atr) == []


def test_atr_counts_the_first_bar_and_needs_a_prior_session(spark):
    prior = bars(spark, [(570, 100.0, 102.0, 99.0, 101.0, 1.0), (575, 101.0, 105.0, 100.0, 102.0, 1.0)], day=PRIOR)
    frame = prior.unionByName(bars(spark, RANGE + [LONG, (590, 103.0, 108.0, 102.0, 107.0, 1.0)]))
    got = {r["date"]: r["atr"] for r in orb.prior_session_atr(frame, 1).collect()}
    assert got == {PRIOR: None, DAY: 4.0}  # mean of 3 (high - low only) and 5
    assert [r["date"] for r in orb.run_breakout(frame).collect()] == [DAY]
    gate = frame.select("ticker", "date").filter(F.col("date") == F.lit(PRIOR))
    assert orb.run_breakout(frame, gate=gate).count() == 0


def test_signal_is_stable_when_the_future_is_cut(spark):
    full = bars(spark, RANGE + [LONG, (590, 103.0, 110.0, 90.0, 91.0, 9000.0)])
    scale = spark.createDataFrame([("AAA", DAY, 2.0)], "ticker string, date date, atr double")
    a, b = (orb.breakout_signals(f, BreakoutConfig(), scale).collect() for f in (full, full.filter("minute <= 585")))
    assert a == b and len(a) == 1


def price_rows(highs, lows):
    return [(570 + 5 * i, 0.0, float(h), float(lo), 0.0, 1.0) for i, (h, lo) in enumerate(zip(highs, lows))]


@pytest.mark.parametrize(
    "values, wing, found", [([1, 2, 3, 2, 1], 2, [2]), ([3, 3, 3, 3, 3], 2, []), ([1, 3, 1, 1, 4, 1, 1], 1, [1, 4])]
)
def test_swings(spark, values, wing, found):
    rows = swp.swings(swp.bar_index(bars(spark, price_rows(values, [-v for v in values]))), wing)
    got = rows.orderBy("idx").collect()
    assert [r["idx"] for r in got if r["is_swing_high"]] == found == [r["idx"] for r in got if r["is_swing_low"]]


@pytest.mark.parametrize(
    "highs, lows, gap", [([5, 20, 25], [3, 8, 10], ("bull", 5.0, 10.0)), ([12, 9, 6], [10, 3, 2], ("bear", 6.0, 10.0)), ([10, 11, 10], [8, 9, 8], None)]
)
def test_fair_value_gaps(spark, highs, lows, gap):
    rows = swp.fair_value_gaps(swp.bar_index(bars(spark, price_rows(highs, lows)))).orderBy("idx").collect()
    assert [r["idx"] for r in rows if r["fvg"]] == ([1] if gap else [])
    if gap:
        assert (rows[1]["fvg"], rows[1]["fvg_bottom"], rows[1]["fvg_top"]) == gap


def test_sweep_trade_end_to_end(spark):
    """Poke below the prior low, reclaim, swing high at 99.5, close above it, limit filled, target reached."""
    hlc = [(98, 97, 97.5), (98, 95.5, 96.8), (99, 96.5, 98.5), (99.5, 98, 98.8), (99, 97.5, 98), (98.8, 97, 98.2), (100.5, 98, 100.2),
           (100.6, 99.9, 100.4), (115, 100, 114), (114, 113, 113.5)]
    frame = bars(spark, [(570 + 5 * i, 0.0, h, lo, c, 1.0) for i, (h, lo, c) in enumerate([(float(a), float(b), float(c)) for a, b, c in hlc])])
    daily = spark.createDataFrame([("AAA", PRIOR, 110.0, 96.0), ("AAA", DAY, 115.0, 95.5)], "ticker string, date date, high double, low double")
    configs = (SweepConfig(rr=1.0), SweepConfig(target_mode="liquidity"))
    got = {r["setting"]: r for r in swp.compound_r(swp.sweep_trades(frame, daily, configs, 0.01)).collect()}
    one = got["1R"]
    assert (one["direction"], one["signal_minute"], one["used_fvg"], one["entry"]) == (1, 600, False, 100.2)
    assert one["stop"] == pytest.approx(95.5 - 0.05 * 4.7) and one["exit_reason"] == "target"
    assert one["r_multiple"] == pytest.approx(1 - 0.02 / (100.2 - one["stop"])) and one["pnl"] == pytest.approx(100 * one["r_multiple"])
    assert got["liquidity"]["target"] == 110.0 and got["liquidity"]["exit_minute"] == 610
    stats = {r["setting"]: r for r in strategy_stats(swp.compound_r(swp.sweep_trades(frame, daily, configs, 0.01))).collect()}
    assert stats["1R"]["profit_factor"] == float("inf") and stats["1R"]["max_drawdown_pct"] == 0.0


@pytest.mark.parametrize("sessions", [1, 3])
def test_one_pass_equals_signals_joined_with_their_bars(spark, sessions):
    rth = Fixture(configure(spark), "/root/testdata/sf0.001").rth.cache()
    config = replace(BREAKOUT, atr_lookback_sessions=sessions)
    plain, once = orb.breakout_trades(orb.breakout_signals(rth, config), rth, config, CostModel()), orb.run_breakout(rth, config)
    plain, once = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()) for t in (plain, once))
    assert plain and once == plain
    nobody = rth.withColumn("ticker", F.lit(None).cast("string"))
    assert orb.run_breakout(nobody, config).count() == 0 == orb.run_breakout(rth.limit(0), config).count()
    rth.unpersist()


def test_gaps_on_bars_equal_gaps_of_sessions(spark):
    rth = Fixture(configure(spark), "/root/testdata/sf0.001").rth
    # Some closes are unknown, the last of a session among them.
    rth = rth.withColumn("close", F.when(F.abs(F.xxhash64("ticker", "date", "minute")) % 3 != 0, F.col("close"))).cache()
    days = {(r["ticker"], r["date"]): r["overnight_gap"] for r in overnight_gaps(rth).collect()}
    rows = with_overnight_gap(rth).collect()
    assert {v is None for v in days.values()} == {True, False}
    assert len(rows) == rth.count() and all(r["overnight_gap"] == days[r["ticker"], r["date"]] for r in rows)
    rth.unpersist()
