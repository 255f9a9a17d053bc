"""What plans must not do: read bars again, grow with the number of folds, run jobs while they are built."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from catalog.fixtures import Fixture
from catalog.models import STUDY
from tapeworks.models import boosting
from tapeworks.operators.asof import range_bars_asof
from tapeworks.operators.breakout import run_breakout
from tapeworks.operators.intraday import CONTEXT, build_price_features
from tapeworks.operators.news import tagged_news
from tapeworks.plans import backtest
from tapeworks.plans.backtest import walk_forward_run
from tapeworks.plans.feature_tables import bar_feature_table, session_feature_table
from tapeworks.runtime import configure
from tapeworks.sources.calendar import next_session, session_calendar

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def fx(spark):
    return Fixture(configure(spark), FOLDER)


def test_session_features_read_the_bars_once(fx):
    table = session_feature_table(fx.bars, fx.calendar, tagged_news(fx.articles, fx.tags))
    bars = len(re.findall(r"Relation \[event_id", plan_of(fx.bars)))
    assert len(re.findall(r"Relation \[event_id", plan_of(table))) == bars


def test_the_breakout_reads_and_shuffles_the_bars_once(fx):
    plans = plan_of(fx.rth), plan_of(run_breakout(fx.rth))
    scans = [len(re.findall(r"Relation \[event_id", p)) for p in plans]
    assert scans[0] == scans[1]
    text = run_breakout(fx.rth)._jdf.queryExecution().executedPlan().toString()
    base = fx.rth._jdf.queryExecution().executedPlan().toString()
    shuffles = [len(re.findall(r"Exchange hashpartitioning", p)) for p in (base, text)]
    assert shuffles[1] == shuffles[0] + 1


def test_price_features_read_the_bars_once_and_the_context_by_its_tickers(fx):
    base, plan = plan_of(fx.rth), plan_of(build_price_features(fx.rth))
    once = len(re.findall(r"Relation \[event_id", base))
    assert len(re.findall(r"Relation \[event_id", plan)) == 2 * once
    assert len(re.findall(rf"IN \(({'|'.join(CONTEXT)}),({'|'.join(CONTEXT)})\)", plan)) == 1
    executed = build_price_features(fx.rth)._jdf.queryExecution().executedPlan().toString()
    reads = fx.rth._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    # Bars by ticker once; the context by its own sessions and by (date, minute).
    assert executed.count("Exchange hashpartitioning") <= 2 * reads + 3


def test_a_study_types_the_news_once(fx, monkeypatch):
    reads = []
    monkeypatch.setattr(backtest, "session_feature_table", lambda bars, calendar, tagged: reads.extend((bars, tagged)) or session_feature_table(bars, calendar, tagged))
    monkeypatch.setattr(backtest, "bar_feature_table", lambda rth, tagged: reads.extend((rth, tagged)) or bar_feature_table(rth, tagged))
    backtest.prepare(fx.bars, fx.calendar, STUDY, tagged_news(fx.articles, fx.tags))
    assert len(reads) == 4
    for frame in reads:
        plan = plan_of(frame)
        assert "event_id" not in plan and "text" not in plan and "RLIKE" not in plan


@pytest.mark.parametrize("name", ["opportunity_classifier", "quantile_forecaster", "cost_heads"])
def test_fitted_rows_are_computed_once(spark, name, monkeypatch):
    seen = []
    monkeypatch.setattr(boosting, "_start", lambda rows, *_: seen.append(rows) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        QUERIES[name](spark, FOLDER)
    plan = plan_of(seen[0])
    assert "event_id" not in plan and "text" not in plan


def test_the_plan_of_many_folds_is_that_of_few(spark):
    rows = spark.range(100).select("id", (F.col("id") % 20).cast("int").alias("part"))
    runs = {n: walk_forward_run(list(range(n)), lambda k: rows.filter(F.col("part") == k).select("id"), in_flight=3) for n in (2, 20)}
    assert len({len(plan_of(r).splitlines()) for r in runs.values()}) == 1
    assert sorted((r["id"], r["fold_id"]) for r in runs[20].collect()) == [(i, i % 20) for i in range(100)]


def test_a_failing_fold_fails_the_run(spark):
    def run(k):
        if k == 3:
            raise ValueError("fold 3")
        return spark.range(1)

    with pytest.raises(ValueError, match="fold 3"):
        walk_forward_run(list(range(6)), run)
    with pytest.raises(ValueError, match="no folds"):
        walk_forward_run([], run)


def test_reading_a_range_starts_no_job(spark, fx):
    spark.sparkContext.setJobGroup("only-plans", "no job may run")
    try:
        frame = range_bars_asof(fx.bars, fx.calendar, "2024-01-02", "2024-01-05")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("only-plans")
        assert frame.count() > 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_next_session_is_a_running_value(spark):
    calendar = session_calendar(spark, "2024-01-01", "2024-03-31")
    rows = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-04-02')) AS date")
    got = next_session(rows, calendar)
    assert "unboundedfollowing" not in plan_of(got).lower()
    days = sorted(r["date"] for r in calendar.select("date").collect())
    assert all(r["next_session"] == next((d for d in days if d > r["date"]), None) for r in got.collect())
