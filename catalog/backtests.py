"""What a back-test leaves behind, on forecasts that SQL can make too: trades, counters, totals, curve, record, and two gated arms."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, functions as F

from tapeworks.operators.decisions import decide, select_candidates
from tapeworks.operators.folds import TEST, tag_folds
from tapeworks.operators.news import bar_news, tagged_news
from tapeworks.operators.trades import decision_universe, thin_events, trade_summary
from tapeworks.plans.backtest import RECORDED, BacktestResult, stitched
from tapeworks.runtime import checkpoint_dir
from tapeworks.sources.tables import write_labels, write_trades

from .fixtures import Fixture
from .labels import fixture_folds, fixture_labels
from .news import wire
from .registry import day, q6, q6s, query, r6, rounded, view
from .trading import (
    COST, COSTS, DECISION, NUMBERS, RISK, curve_views, decide_sql, gap_scores, predictions, summary_sql,
)

KEY = "ticker, CAST(d AS VARCHAR) AS date, CAST(m AS INT) AS minute"
FLOOR, MOST = 0.02, 2


@view("bt_picked", "gap_scores", "folds")
def _picked():
    ranked = f"SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, ticker) AS nth FROM gap_scores WHERE score >= {FLOOR}"
    return f"SELECT f.fold_id, g.ticker, g.d FROM ({ranked}) g JOIN folds f ON f.d = g.d AND f.segment = 'test' WHERE g.nth <= {MOST}"


@view("bt_trades", "thinned", "bt_picked")
def _trades():
    return "SELECT p.fold_id, t.* FROM thinned t JOIN bt_picked p ON p.ticker = t.ticker AND p.d = t.d"


@view("bt_summary", "bt_trades", "bt_picked", "decided", "folds")
def _summary():
    universe = """SELECT f.fold_id, f.n_days, coalesce(r.n, 0) AS n_decision_rows, coalesce(c.n, 0) AS n_candidates, coalesce(c.days, 0) AS candidate_days
FROM (SELECT fold_id, count(DISTINCT d) AS n_days FROM folds WHERE segment = 'test' GROUP BY fold_id) f
LEFT JOIN (SELECT p.fold_id, count(*) AS n FROM decided x JOIN bt_picked p ON p.ticker = x.ticker AND p.d = x.d GROUP BY p.fold_id) r ON r.fold_id = f.fold_id
LEFT JOIN (SELECT fold_id, count(*) AS n, count(DISTINCT d) AS days FROM bt_picked GROUP BY fold_id) c ON c.fold_id = f.fold_id"""
    counters = "(SELECT fold_id, n_days, n_candidates, candidate_days FROM (" + universe + "))"
    return f"SELECT t.*, c.n_days, c.n_candidates, c.candidate_days FROM ({summary_sql('bt_trades', universe, 'fold_id', 's.fold_id = u.fold_id')}) t JOIN {counters} c ON c.fold_id = t.fold_id"


def naive_backtest(fx: Fixture) -> BacktestResult:
    """Candidates by the gap, forecasts from the session before."""
    folds = fixture_folds(fx)
    picked = tag_folds(select_candidates(gap_scores(fx), FLOOR, MOST), folds.filter(F.col("segment") == TEST)).select("fold_id", "ticker", "date")
    rows = decide(predictions(fx), COSTS, DECISION).join(picked, ["ticker", "date"])
    return stitched(rows, picked, folds, COSTS, RISK, {"decisions": DECISION})


@query("backtest_trades", "bt_trades", sql=f"SELECT fold_id, {KEY}, direction, {q6s('gross_ret', 'net_ret', 'q10')} FROM bt_trades")
def _(fx):
    return naive_backtest(fx).trades.select("fold_id", "ticker", day(), "minute", "direction", *rounded("gross_ret", "net_ret", "q10"))


COUNTERS = "n_trades", "n_long", "n_short", "n_days", "n_candidates", "candidate_days"


@query("backtest_summary", "bt_summary", sql=f"SELECT fold_id, {', '.join(COUNTERS)}, {q6s(*NUMBERS)} FROM bt_summary")
def _(fx):
    return naive_backtest(fx).summary.select("fold_id", *COUNTERS, *rounded(*NUMBERS))


@query(
    "backtest_totals",
    "bt_summary",
    sql=f"""SELECT count(*) AS n_folds, count(CASE WHEN n_trades > 0 THEN 1 END) AS n_folds_traded, CAST(sum(n_trades) AS BIGINT) AS n_trades,
  {q6('sum(total_net_return)')} AS total_net_return, {q6('avg(CASE WHEN n_trades > 0 THEN hit_rate END)')} AS mean_hit_rate,
  {q6('avg(CASE WHEN n_trades > 0 THEN avg_net_bps END)')} AS mean_net_bps FROM bt_summary""",
)
def _(fx):
    return naive_backtest(fx).totals.select("n_folds", "n_folds_traded", "n_trades", *rounded("total_net_return", "mean_hit_rate", "mean_net_bps"))


curve_views(
    "btc",
    "SELECT 'stitched' AS run_id, d, CAST(m + 5 AS INT) AS entry, CAST(m + 20 AS INT) AS exit_m, net_ret, q10 FROM bt_trades",
    "SELECT DISTINCT 'stitched' AS run_id FROM bt_trades",
    "bt_trades",
)


@query("backtest_curve", "btc_curve", sql=f"SELECT CAST(d AS VARCHAR) AS date, CAST(x AS INT) AS exit_minute, n_closed, {q6s('equity', 'drawdown')} FROM btc_curve")
def _(fx):
    return naive_backtest(fx).curve.exits.select(day(), "exit_minute", "n_closed", *rounded("equity", "drawdown"))


@query(
    "backtest_record",
    "bt_summary",
    "folds",
    sql=f"""SELECT fold_id, 'end_to_end_backtest' AS experiment, CAST(b.train_from AS VARCHAR) AS train_from, CAST(b.test_to AS VARCHAR) AS test_to,
  {q6(str(DECISION.min_edge_bps))} AS min_edge_bps, {q6s(*RECORDED)} FROM bt_summary s JOIN (SELECT fold_id, min(CASE WHEN segment = 'train' THEN d END) AS train_from,
  max(CASE WHEN segment = 'test' THEN d END) AS test_to FROM folds GROUP BY fold_id) b USING (fold_id)""",
)
def _(fx):
    folds = naive_backtest(fx).record.select("experiment", "config", F.explode("folds").alias("f"))
    edge = F.get_json_object("config", "$.decisions.min_edge_bps")
    return folds.select(
        "f.fold_id", "experiment", F.col("f.train_from").cast("string").alias("train_from"), F.col("f.test_to").cast("string").alias("test_to"),
        r6(edge).alias("min_edge_bps"), *[r6(F.col("f.metrics")[m]).alias(m) for m in RECORDED],
    )


# ---- gated arms: decisions by win probability, and with news that agrees -----------------------------------------------------------

COST_AWARE = dataclasses.replace(DECISION, min_p_win=0.3)
WITH_NEWS = dataclasses.replace(DECISION, min_news_articles_2h=1.0, align_news_sentiment=True)


def thinned_views(prefix: str, decided: str, *needs: str) -> None:
    """Decisions of an arm, thinned by a walk from signal to signal, and summed up for each ticker."""

    @view(f"{prefix}_decided", *needs)
    def _():
        return decided

    @view(f"{prefix}_signals", f"{prefix}_decided")
    def _():
        later = f"""(SELECT min(n.m) FROM {prefix}_decided n WHERE n.ticker = s.ticker AND n.d = s.d AND n.m >= s.m + 15 AND n.decision <> 'hold'
  AND n.fwd_ret_15m IS NOT NULL)"""
        gross = "CASE s.decision WHEN 'long' THEN fwd_ret_15m ELSE -fwd_ret_15m END"
        return f"""SELECT s.ticker, s.d, s.m, s.decision AS direction, {gross} AS gross_ret, {gross} - {COST} AS net_ret, {later} AS next_m,
  row_number() OVER (PARTITION BY s.ticker, s.d ORDER BY s.m) AS nth FROM {prefix}_decided s WHERE s.decision <> 'hold' AND s.fwd_ret_15m IS NOT NULL"""

    @view(f"{prefix}_walk", f"{prefix}_signals", recursive=True)
    def _():
        return f"""SELECT * FROM {prefix}_signals WHERE nth = 1
UNION ALL SELECT s.* FROM {prefix}_walk k JOIN {prefix}_signals s ON s.ticker = k.ticker AND s.d = k.d AND s.m = k.next_m"""

    @view(f"{prefix}_tickers", f"{prefix}_walk", f"{prefix}_decided")
    def _():
        universe = f"SELECT ticker, count(*) AS n_decision_rows, count(DISTINCT d) AS n_days FROM {prefix}_decided GROUP BY ticker"
        return summary_sql(f"{prefix}_walk", universe, "ticker", "s.ticker = u.ticker")


thinned_views("aware", decide_sql("fx_pred", COST_AWARE), "fx_pred")
thinned_views("newsy", decide_sql("pred_news", WITH_NEWS), "pred_news")


def arm(rows: DataFrame, config) -> DataFrame:
    decided = decide(rows, COSTS, config)
    summary = trade_summary(thin_events(decided, COSTS), decision_universe(decided, "ticker"), "ticker")
    return summary.select("ticker", "n_trades", "n_long", "n_short", *rounded(*NUMBERS))


@query("cost_aware_arm", "aware_tickers", sql=f"SELECT ticker, n_trades, n_long, n_short, {q6s(*NUMBERS)} FROM aware_tickers")
def _(fx):
    return arm(predictions(fx), COST_AWARE)


@query("news_gated_arm", "newsy_tickers", sql=f"SELECT ticker, n_trades, n_long, n_short, {q6s(*NUMBERS)} FROM newsy_tickers")
def _(fx):
    return arm(bar_news(predictions(fx), tagged_news(wire(fx), fx.tags)), WITH_NEWS)


# ---- sinks: written, and read back ---------------------------------------------------------------------------------------------------

TRADE_FILE = "fold_id int, ticker string, date date, minute int, direction string, gross_ret double, net_ret double, q10 double"


def _folder(fx: Fixture) -> str:
    return f"{checkpoint_dir(fx.spark).rstrip('/')}/written-{uuid.uuid4().hex}"


@query("written_trades", "bt_trades", sql=f"SELECT fold_id, {KEY}, direction, {q6s('gross_ret', 'net_ret', 'q10')} FROM bt_trades")
def _(fx):
    path = _folder(fx)
    write_trades(naive_backtest(fx).trades, path)
    back = fx.spark.read.schema(TRADE_FILE).option("header", True).csv(path)
    return back.select("fold_id", "ticker", day(), "minute", "direction", *rounded("gross_ret", "net_ret", "q10"))


@query("written_labels", "labelled", sql="SELECT ticker, CAST(d AS VARCHAR) AS date, label FROM labelled")
def _(fx):
    path = _folder(fx)
    write_labels(fixture_labels(fx).labels.select("ticker", "date", "label"), path)
    return fx.spark.read.schema("ticker string, date date, label string").option("header", True).csv(path).select("ticker", day(), "label")
