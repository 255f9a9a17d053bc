import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from frames import DAY, PRIOR
from tapeworks.config import CostModel, DecisionConfig, RiskConfig
from tapeworks.operators.decisions import decide, select_candidates, size_position
from tapeworks.operators.metrics import across_folds, classifier_metrics, forecast_metrics, ranking_metrics
from tapeworks.operators.curve import realised_curve
from tapeworks.operators.trades import decision_universe, thin_events, trade_summary

ROW = (
    "name string, q10 double, q50 double, q90 double, r30 double, minutes_to_close double, minutes_since_open double, "
    "news_articles_2h double, news_sent_signed_2h double, p_long_win double, p_short_win double"
)
LONG = dict(q10=-0.002, q50=0.003, q90=0.006, r30=0.0, minutes_to_close=60.0, minutes_since_open=30.0, news_articles_2h=None,
            news_sent_signed_2h=None, p_long_win=0.1, p_short_win=0.1)
SHORT = {**LONG, "q10": -0.006, "q50": -0.003, "q90": 0.002}


@pytest.mark.parametrize(
    "config, cases",
    [
        (DecisionConfig(), [
            ({}, "long"), ({"q50": 0.001}, "hold"), ({"q10": -0.02}, "hold"), ({"r30": -0.004}, "hold"), ({"r30": None}, "hold"),
            ({"minutes_to_close": 15.0}, "hold"), (SHORT, "short"), ({**SHORT, "q90": 0.02}, "hold"), ({**SHORT, "r30": 0.004}, "hold"),
        ]),
        (DecisionConfig(min_news_articles_2h=1), [({}, "hold"), ({"news_articles_2h": 0.0}, "hold"), ({"news_articles_2h": 2.0}, "long")]),
        (DecisionConfig(align_news_sentiment=True), [
            ({}, "hold"), ({"news_sent_signed_2h": 0.0}, "hold"), ({"news_sent_signed_2h": 1.0}, "long"), ({**SHORT, "news_sent_signed_2h": 1.0}, "hold"),
            ({**SHORT, "news_sent_signed_2h": -1.0}, "short"),
        ]),
        (DecisionConfig(max_minutes_since_open=30), [({}, "long"), ({"minutes_since_open": 31.0}, "hold"), ({"minutes_since_open": None}, "hold")]),
        (DecisionConfig(min_p_win=0.5), [({}, "hold"), ({"p_long_win": 0.6}, "long"), ({"p_short_win": 0.6}, "short"), ({"p_long_win": 0.6, "p_short_win": 0.6}, "short")]),
    ],
)
def test_decisions(spark, config, cases):
    columns = [c.split()[0] for c in ROW.split(", ")]
    rows = [tuple({**LONG, **change, "name": str(i)}[c] for c in columns) for i, (change, _) in enumerate(cases)]
    got = {int(r["name"]): r["decision"] for r in decide(spark.createDataFrame(rows, ROW), CostModel(), config).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_sizes(spark):
    rows = spark.createDataFrame([(-0.01,), (-0.05,), (-0.00001,), (None,)], "q10 double")
    assert [r[0] for r in rows.select(size_position(F.col("q10"))).collect()] == pytest.approx([0.2, 0.1, 0.2, None])


def test_thinning_skips_overlaps_and_unknown_returns(spark):
    rows = [(570, "long", 0.01), (575, "long", 0.5), (580, "short", 0.5), (585, "short", 0.02), (590, "hold", 0.1), (600, "long", None), (605, "long", -0.01)]
    frame = spark.createDataFrame([("AAA", DAY, m, d, f) for m, d, f in rows], "ticker string, date date, minute int, decision string, fwd_ret_15m double")
    got = thin_events(frame).orderBy("minute").collect()
    assert [(r["minute"], r["direction"]) for r in got] == [(570, "long"), (585, "short"), (605, "long")]
    assert [r["gross_ret"] for r in got] == [0.01, -0.02, -0.01] and got[0]["net_ret"] == pytest.approx(0.0089) and got[0]["q10"] is None
    summary = {r["ticker"]: r for r in trade_summary(thin_events(frame), decision_universe(frame.unionByName(frame.withColumn("ticker", F.lit("ZZZ"))), "ticker"), "ticker").collect()}
    assert summary["AAA"]["n_trades"] == 3 and summary["AAA"]["hit_rate"] == pytest.approx(1 / 3)
    assert summary["AAA"]["hold_fraction"] == pytest.approx(1 - 3 / 7) and summary["AAA"]["median_net_bps"] == pytest.approx(-111.0)


def test_summary_without_trades(spark):
    none = spark.createDataFrame([], "run string, direction string, net_ret double, gross_ret double")
    universe = spark.createDataFrame([("x", 10, 2)], "run string, n_decision_rows bigint, n_days bigint")
    row = trade_summary(none, universe, "run").first()
    assert (row["n_trades"], row["trades_per_day"], row["hold_fraction"], row["total_net_return"], row["hit_rate"]) == (0, 0.0, 1.0, 0.0, None)


TRADE = "run_id string, date date, minute int, ticker string, net_ret double, q10 double"


def curve_of(spark, rows, config=RiskConfig(), schema=TRADE):
    return realised_curve(spark.createDataFrame(rows, schema), config)


def test_limits_are_reported(spark):
    two = [("r", DAY, 600, "A", 0.01, -0.005), ("r", DAY, 605, "B", 0.01, -0.005)]
    row = curve_of(spark, two, RiskConfig(max_positions=1)).summary.first()
    assert (row["n_trades"], row["peak_open"], row["n_over_limit"], row["n_loss_days"]) == (2, 2, 1, 0)
    rows = [("r", PRIOR, 600, "A", -0.01, -0.005), ("r", PRIOR, 660, "A", 0.05, -0.005), ("r", DAY, 600, "A", 0.02, -0.005)]
    row = curve_of(spark, rows, RiskConfig(max_positions=10, daily_loss_limit=0.001)).summary.first()
    assert row["n_loss_days"] == 1 and row["max_drawdown"] == 0.0  # the first exit is the first peak
    assert row["final_equity"] == pytest.approx(100_000 * (1 - 0.002 + 0.01) * 1.004)


def test_unknown_downside_is_refused(spark):
    with pytest.raises(Exception, match="q10 is unknown"):
        curve_of(spark, [("r", DAY, 600, "A", 0.01, None)]).summary.collect()


def test_runs_without_trades_report(spark):
    none = spark.createDataFrame([], TRADE)
    runs = spark.createDataFrame([("x",), ("y",)], "run_id string")
    found = {r["run_id"]: r for r in realised_curve(none, RiskConfig(), runs).summary.collect()}
    assert set(found) == {"x", "y"} and found["x"]["final_equity"] == RiskConfig().initial_equity and found["x"]["n_trades"] == 0


def test_curve_against_a_plain_sum(spark):
    rng, rows = random.Random(11), []
    for run in range(4):
        for d in range(6):
            for _ in range(rng.randint(0, 20)):
                minute = 570 + 5 * rng.randint(0, 70)
                rows.append((f"r{run}", DAY + dt.timedelta(days=d), minute, "T", rng.gauss(0, 0.03), rng.uniform(-0.03, -0.0001), minute + 5, minute + 5 + 5 * rng.randint(0, 6)))
    config = RiskConfig(max_positions=3)
    done = curve_of(spark, rows, config, TRADE + ", entry_minute int, exit_minute int")
    curves = {}
    for r in done.exits.orderBy("run_id", "date", "exit_minute").collect():
        curves.setdefault(r["run_id"], []).append((r["equity"], r["drawdown"]))
    for r in done.summary.collect():
        mine, equity, points = [x for x in rows if x[0] == r["run_id"]], config.initial_equity, []
        for day in sorted({x[1] for x in mine}):
            start, today = equity, [x for x in mine if x[1] == day]
            for leave in sorted({x[7] for x in today}):
                equity += start * sum(min(config.risk_per_trade / max(abs(x[5]), config.q10_floor), config.max_name_fraction) * x[4] for x in today if x[7] == leave)
                points.append(equity)
        assert r["final_equity"] == pytest.approx(equity, rel=1e-9)
        assert [e for e, _ in curves[r["run_id"]]] == pytest.approx(points, rel=1e-9)
        assert [d for _, d in curves[r["run_id"]]] == pytest.approx([e / max(points[: i + 1]) - 1 for i, e in enumerate(points)], abs=1e-9)


def test_ranking_by_hand(spark):
    rows = [(PRIOR, "A", "sustained", 0.9), (PRIOR, "B", "none", 0.8), (PRIOR, "C", "opening_only", 0.1), (DAY, "A", "none", None)]
    frame = spark.createDataFrame(rows, "date date, ticker string, label string, score double")
    row = ranking_metrics(frame, "score", 2).first()
    assert (row["p_at_2"], row["capture_at_2"]) == (0.25, 0.5)


def test_forecast_and_class_metrics_by_hand(spark):
    rows = spark.createDataFrame([(0.01, -0.02, 0.005, 0.02), (-0.03, -0.02, 0.005, 0.02), (0.0, -0.02, 0.0, 0.02), (None, 0.0, 0.0, 0.0)], "fwd_ret_15m double, q10 double, q50 double, q90 double")
    row = forecast_metrics(rows).first()
    assert (row["n_rows"], row["coverage_80"], row["direction_accuracy"]) == (3, pytest.approx(2 / 3), 0.5)
    assert row["pinball_q10"] == pytest.approx((0.1 * 0.03 + 0.9 * 0.01 + 0.1 * 0.02) / 3)
    assert row["pinball_q50_vs_baseline"] == pytest.approx((0.0025 + 0.0175) / (0.005 + 0.015))
    p = spark.createDataFrame([("none", 0.5, 0.25, 0.25), ("sustained", 0.5, 0.25, 0.25)], "label string, p_none double, p_opening_only double, p_sustained double")
    got = classifier_metrics(p).first()
    assert got["accuracy"] == 0.5 and got["precision_none"] == 0.5 and got["recall_sustained"] == 0.0
    assert got["brier"] == pytest.approx(((0.25 + 0.0625 * 2) + (0.25 + 0.0625 + 0.5625)) / 2)
    folds = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, None)], "fold_id int, a double, b double")
    assert {r["metric"]: (r["mean"], r["n_folds"]) for r in across_folds(folds, "a", "b").collect()} == {"a": (2.0, 2), "b": (2.0, 1)}


def test_candidates(spark):
    rows = spark.createDataFrame([(DAY, t, s) for t, s in (("A", 0.9), ("B", 0.9), ("C", 0.7), ("D", 0.2), ("E", None))], "date date, ticker string, score double")
    assert sorted(r["ticker"] for r in select_candidates(rows, 0.5, 2).collect()) == ["A", "B"]
    assert select_candidates(rows, 0.5, None).count() == 3
