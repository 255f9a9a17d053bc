"""Decisions, thinning, summaries, realised curves, forecast and ranking metrics, comparisons."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, Window, functions as F

from tapeworks.config import LABELS, CostModel, DecisionConfig, RiskConfig
from tapeworks.functions.scalars import argmax_index, linear_score, log_probability, sorted_quantiles, threshold_flag
from tapeworks.operators.breakout import run_breakout
from tapeworks.operators.curve import realised_curve
from tapeworks.operators.decisions import decide, select_candidates, size_position
from tapeworks.operators.folds import TEST, tag_folds
from tapeworks.operators.intraday import TARGET, build_price_features
from tapeworks.operators.metrics import (
    FORECAST_METRICS,
    across_folds,
    class_prior,
    classifier_metrics,
    compare_rankers,
    forecast_metrics,
    label_index,
    precision_score,
    ranking_metrics,
)
from tapeworks.operators.news import bar_news, tagged_news
from tapeworks.operators.premarket import build_snapshot_features
from tapeworks.operators.trades import SUMMARY, decision_universe, thin_events, trade_summary
from tapeworks.plans.comparisons import arm_compare, arm_curves, arm_trades, slice_ablation

from .fixtures import BREAKOUT, Fixture
from .labels import fixture_folds, fixture_labels, fixture_stability
from .news import wire
from .registry import day, q6, q6s, query, r6, rounded, view

COSTS, RISK = CostModel(), RiskConfig()
COST = COSTS.round_trip_cost
# The fixture tape moves by percents per bar, so risk and trend limits are opened accordingly.
DECISION = DecisionConfig(max_risk_bps=5000.0, trend_oppose_bps=3000.0)
GATED = DecisionConfig(
    max_risk_bps=5000.0,
    trend_oppose_bps=3000.0,
    min_news_articles_2h=1.0,
    align_news_sentiment=True,
    max_minutes_since_open=240.0,
)
WIN = DecisionConfig(max_risk_bps=5000.0, trend_oppose_bps=3000.0, min_p_win=0.45)
K = 2
KEY = "ticker, CAST(d AS VARCHAR) AS date, CAST(m AS INT) AS minute"
DAY_KEY = "ticker, CAST(d AS VARCHAR) AS date"


# ---- a forecaster both engines can state: the quantiles of the ticker's previous session ---------------------


def naive_forecast(features: DataFrame) -> DataFrame:
    y = F.col(TARGET)
    cost = F.lit(COST)
    days = features.groupBy("ticker", "date").agg(
        F.percentile(y, F.array(*[F.lit(q) for q in (0.1, 0.5, 0.9)])).alias("q"),
        F.avg(F.when(y.isNotNull(), (y > cost).cast("double"))).alias("up"),
        F.avg(F.when(y.isNotNull(), (y < -cost).cast("double"))).alias("down"),
    )
    order = Window.partitionBy("ticker").orderBy("date")
    lagged = days.select("ticker", "date", *[F.lag(c).over(order).alias(c) for c in ("q", "up", "down")])
    named = lagged.select(
        "ticker",
        "date",
        *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q10", "q50", "q90"))],
        F.col("up").alias("p_long_win"),
        F.col("down").alias("p_short_win"),
    )
    return features.join(named, ["ticker", "date"])


@view("fx_pred", "bar_features")
def _pred():
    return f"""SELECT f.*, p.q10, p.q50, p.q90, p.p_long_win, p.p_short_win FROM bar_features f JOIN (
  SELECT ticker, d, lag(a) OVER t AS q10, lag(b) OVER t AS q50, lag(c) OVER t AS q90, lag(up) OVER t AS p_long_win,
    lag(down) OVER t AS p_short_win FROM (SELECT ticker, d, quantile_cont(fwd_ret_15m, 0.1) AS a,
      quantile_cont(fwd_ret_15m, 0.5) AS b, quantile_cont(fwd_ret_15m, 0.9) AS c,
      avg(CASE WHEN fwd_ret_15m > {COST} THEN 1.0 WHEN fwd_ret_15m IS NOT NULL THEN 0.0 END) AS up,
      avg(CASE WHEN fwd_ret_15m < -{COST} THEN 1.0 WHEN fwd_ret_15m IS NOT NULL THEN 0.0 END) AS down
    FROM bar_features GROUP BY ticker, d) WINDOW t AS (PARTITION BY ticker ORDER BY d)) p
  ON p.ticker = f.ticker AND p.d = f.d"""


def predictions(fx: Fixture) -> DataFrame:
    return naive_forecast(build_price_features(fx.rth))


def decide_sql(source: str, c: DecisionConfig, columns: str = "*") -> str:
    hurdle, risk, oppose = COST + c.min_edge_bps / 1e4, c.max_risk_bps / 1e4, c.trend_oppose_bps / 1e4
    gate = f"minutes_to_close >= {c.min_minutes_to_close}"
    if c.min_news_articles_2h > 0:
        gate += f" AND news_articles_2h >= {c.min_news_articles_2h}"
    if c.max_minutes_since_open > 0:
        gate += f" AND minutes_since_open <= {c.max_minutes_since_open}"
    up, down = (f"p_long_win >= {c.min_p_win}", f"p_short_win >= {c.min_p_win}") if c.min_p_win > 0 else (
        f"q50 >= {hurdle}",
        f"q50 <= -{hurdle}",
    )
    long = f"{up} AND q10 >= -{risk} AND r30 > -{oppose} AND {gate}"
    short = f"{down} AND q90 <= {risk} AND r30 < {oppose} AND {gate}"
    if c.align_news_sentiment:
        long, short = f"{long} AND news_sent_signed_2h > 0", f"{short} AND news_sent_signed_2h < 0"
    return f"SELECT {columns}, CASE WHEN {short} THEN 'short' WHEN {long} THEN 'long' ELSE 'hold' END AS decision FROM {source}"


@view("decided", "fx_pred")
def _decided():
    return decide_sql("fx_pred", DECISION)


@view("pred_news", "fx_pred", "bar_news")
def _pred_news():
    return """SELECT p.*, n.news_articles_2h, n.news_sent_signed_2h FROM fx_pred p
JOIN bar_news n ON n.ticker = p.ticker AND n.d = p.d AND n.m = p.m"""


@query("decide", "decided", sql=f"SELECT {KEY}, decision FROM decided")
def _(fx):
    return decide(predictions(fx), COSTS, DECISION).select("ticker", day(), "minute", "decision")


@query("decide_by_win_probability", "fx_pred", sql=decide_sql("fx_pred", WIN, KEY))
def _(fx):
    return decide(predictions(fx), COSTS, WIN).select("ticker", day(), "minute", "decision")


@query("decision_gates", "pred_news", sql=decide_sql("pred_news", GATED, KEY))
def _(fx):
    rows = bar_news(predictions(fx), tagged_news(wire(fx), fx.tags))
    return decide(rows, COSTS, GATED).select("ticker", day(), "minute", "decision")


SIZE = f"least({RISK.risk_per_trade} / greatest(abs(q10), {RISK.q10_floor}), {RISK.max_name_fraction})"


@query("size_position", "fx_pred", sql=f"SELECT {KEY}, {q6(f'CASE WHEN q10 IS NOT NULL THEN {SIZE} END')} AS fraction FROM fx_pred")
def _(fx):
    return predictions(fx).select("ticker", day(), "minute", r6(size_position(F.col("q10"), RISK)).alias("fraction"))


@query(
    "round_trip_cost",
    "fx_pred",
    sql=f"SELECT {KEY}, {q6('fwd_ret_15m - (5.0 + 2 * 2.5 + 1.0) / 1e4')} AS net_long, "
    f"{q6('-fwd_ret_15m - (5.0 + 2 * 2.5 + 1.0 + 2 * 3.0) / 1e4')} AS net_short_with_impact FROM fx_pred",
)
def _(fx):
    y = F.col(TARGET)
    impact = CostModel(impact_bps=3.0).round_trip_cost
    return predictions(fx).select(
        "ticker", day(), "minute", r6(y - COST).alias("net_long"), r6(-y - impact).alias("net_short_with_impact")
    )


@query(
    "sorted_quantiles",
    "fx_pred",
    sql=f"SELECT {KEY}, {q6('list_sort([q50, q90, q10])[1]')} AS q50, {q6('list_sort([q50, q90, q10])[2]')} AS q90, "
    f"{q6('list_sort([q50, q90, q10])[3]')} AS q10 FROM fx_pred WHERE q10 IS NOT NULL",
)
def _(fx):
    # Fed in scrambled order on purpose.
    rows = predictions(fx).filter(F.col("q10").isNotNull())
    return rows.select("ticker", day(), "minute", *sorted_quantiles("q50", "q90", "q10")).select(
        "ticker", "date", "minute", *rounded("q50", "q90", "q10")
    )


# ---- thinning, summary ----------------------------------------------------------------------------------------


@view("signals", "decided")
def _signals():
    return f"""SELECT s.ticker, s.d, s.m, s.decision, s.q10, CASE s.decision WHEN 'long' THEN fwd_ret_15m ELSE -fwd_ret_15m END AS gross,
  (SELECT min(n.m) FROM decided n WHERE n.ticker = s.ticker AND n.d = s.d AND n.m >= s.m + 15 AND n.decision <> 'hold'
     AND n.fwd_ret_15m IS NOT NULL) AS next_m, row_number() OVER (PARTITION BY s.ticker, s.d ORDER BY s.m) AS nth
FROM decided s WHERE s.decision <> 'hold' AND s.fwd_ret_15m IS NOT NULL"""


@view("kept", "signals", recursive=True)
def _kept():
    return """SELECT ticker, d, m, next_m FROM signals WHERE nth = 1
UNION ALL SELECT s.ticker, s.d, s.m, s.next_m FROM kept k JOIN signals s ON s.ticker = k.ticker AND s.d = k.d AND s.m = k.next_m"""


@view("thinned", "kept", "signals")
def _thinned():
    return f"""SELECT s.ticker, s.d, s.m, s.decision AS direction, s.gross AS gross_ret, s.gross - {COST} AS net_ret, s.q10
FROM kept k JOIN signals s ON s.ticker = k.ticker AND s.d = k.d AND s.m = k.m"""


def fixture_trades(fx: Fixture, *keys: str) -> DataFrame:
    return thin_events(decide(predictions(fx), COSTS, DECISION), COSTS, *keys)


@query("thin_events", "thinned", sql=f"SELECT {KEY}, direction, {q6s('gross_ret', 'net_ret', 'q10')} FROM thinned")
def _(fx):
    return fixture_trades(fx).select("ticker", day(), "minute", "direction", *rounded("gross_ret", "net_ret", "q10"))


NUMBERS = [c for c in SUMMARY if not c.startswith("n_")]


def summary_sql(trades: str, universe: str, keys: str, on: str) -> str:
    first = "u." + keys.replace(", ", ", u.")
    return f"""SELECT {first}, coalesce(n, 0) AS n_trades, coalesce(nl, 0) AS n_long, coalesce(ns, 0) AS n_short,
  coalesce(n, 0) / greatest(u.n_days, 1) AS trades_per_day,
  CASE WHEN n > 0 THEN 1.0 - n / greatest(u.n_decision_rows, 1) ELSE 1.0 END AS hold_fraction, hit_rate, avg_net_bps,
  median_net_bps, coalesce(total, 0.0) AS total_net_return, avg_gross_bps
FROM ({universe}) u LEFT JOIN (SELECT {keys}, count(*) AS n, count(CASE WHEN direction = 'long' THEN 1 END) AS nl,
    count(CASE WHEN direction = 'short' THEN 1 END) AS ns, avg(CASE WHEN net_ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
    avg(net_ret) * 1e4 AS avg_net_bps, median(net_ret) * 1e4 AS median_net_bps, sum(net_ret) AS total,
    avg(gross_ret) * 1e4 AS avg_gross_bps FROM {trades} GROUP BY {keys}) s ON {on}"""


@view("summaries", "thinned", "decided")
def _summaries():
    universe = "SELECT ticker, count(*) AS n_decision_rows, count(DISTINCT d) AS n_days FROM decided GROUP BY ticker"
    return summary_sql("thinned", universe, "ticker", "s.ticker = u.ticker")


@query("trade_summary", "summaries", sql=f"SELECT ticker, n_trades, n_long, n_short, {q6s(*NUMBERS)} FROM summaries")
def _(fx):
    rows = decide(predictions(fx), COSTS, DECISION)
    summary = trade_summary(thin_events(rows, COSTS), decision_universe(rows, "ticker"), "ticker")
    return summary.select("ticker", "n_trades", "n_long", "n_short", *rounded(*NUMBERS))


# ---- realised curves -------------------------------------------------------------------------------------------

RUN_COUNTS = "n_trades", "peak_open", "n_over_limit", "n_loss_days"
RUN_NUMBERS = "final_equity", "total_return", "max_drawdown"


def curve_views(prefix: str, trades: str, runs: str, *needs: str) -> None:
    """Curve and summary over ``trades`` (run_id, d, entry, exit_m, net_ret, q10); ``runs`` lists every run_id."""
    initial, most, limit = RISK.initial_equity, RISK.max_positions, RISK.daily_loss_limit
    size = f"least({RISK.risk_per_trade} / greatest(abs(q10), {RISK.q10_floor}), {RISK.max_name_fraction})"

    @view(f"{prefix}_stakes", *needs)
    def _():
        return f"SELECT run_id, d, entry, exit_m, {size} * net_ret AS pnl FROM ({trades})"

    @view(f"{prefix}_minutes", f"{prefix}_stakes")
    def _():
        # Correlated counts per minute at which something happens, instead of running sums.
        return f"""SELECT e.*, 1.0 + (SELECT coalesce(sum(t.pnl), 0) FROM {prefix}_stakes t WHERE t.run_id = e.run_id AND t.d = e.d AND t.exit_m <= e.x) AS rel,
  (SELECT count(*) FROM {prefix}_stakes t WHERE t.run_id = e.run_id AND t.d = e.d AND t.entry <= e.x AND t.exit_m > e.x)
  - (SELECT count(*) FROM {prefix}_stakes t WHERE t.run_id = e.run_id AND t.d = e.d AND t.exit_m <= e.x AND t.entry > e.x) AS open_now,
  (SELECT count(*) FROM {prefix}_stakes t WHERE t.run_id = e.run_id AND t.d = e.d AND t.exit_m = e.x) AS n_closed
FROM (SELECT run_id, d, entry AS x FROM {prefix}_stakes UNION SELECT run_id, d, exit_m FROM {prefix}_stakes) e"""

    @view(f"{prefix}_days", f"{prefix}_minutes")
    def _():
        return f"""SELECT *, {initial} * coalesce(exp(sum(ln(growth)) OVER (PARTITION BY run_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS start_equity
FROM (SELECT run_id, d, arg_max(rel, x) AS growth, min(rel) AS low FROM {prefix}_minutes GROUP BY run_id, d)"""

    @view(f"{prefix}_curve", f"{prefix}_minutes", f"{prefix}_days")
    def _():
        return f"""SELECT *, equity / max(equity) OVER (PARTITION BY run_id ORDER BY d, x ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
FROM (SELECT m.run_id, m.d, m.x, m.n_closed, y.start_equity * m.rel AS equity FROM {prefix}_minutes m
  JOIN {prefix}_days y ON y.run_id = m.run_id AND y.d = m.d WHERE m.n_closed > 0)"""

    @view(f"{prefix}_summary", f"{prefix}_curve", f"{prefix}_days", f"{prefix}_minutes", *needs)
    def _():
        final = f"coalesce((SELECT arg_max(start_equity * growth, d) FROM {prefix}_days y WHERE y.run_id = r.run_id), {initial})"
        return f"""SELECT *, final_equity / {initial} - 1 AS total_return FROM (SELECT r.run_id, {final} AS final_equity,
  coalesce((SELECT min(drawdown) FROM {prefix}_curve c WHERE c.run_id = r.run_id), 0) AS max_drawdown,
  (SELECT count(*) FROM {prefix}_stakes t WHERE t.run_id = r.run_id) AS n_trades,
  CAST(coalesce((SELECT max(open_now) FROM {prefix}_minutes m WHERE m.run_id = r.run_id), 0) AS BIGINT) AS peak_open,
  (SELECT count(*) FROM {prefix}_minutes m WHERE m.run_id = r.run_id AND open_now > {most}) AS n_over_limit,
  (SELECT count(*) FROM {prefix}_days y WHERE y.run_id = r.run_id AND low - 1 < -{limit}) AS n_loss_days FROM ({runs}) r)"""


# Two books: all tickers in one, and one book per ticker.
curve_views(
    "book",
    "SELECT 'all' AS run_id, d, CAST(m + 5 AS INT) AS entry, CAST(m + 20 AS INT) AS exit_m, net_ret, q10 FROM thinned"
    " UNION ALL SELECT ticker, d, CAST(m + 5 AS INT), CAST(m + 20 AS INT), net_ret, q10 FROM thinned",
    "SELECT 'all' AS run_id UNION SELECT ticker FROM thinned",
    "thinned",
)


def books(fx: Fixture) -> DataFrame:
    runs = F.explode(F.array(F.lit("all"), F.col("ticker"))).alias("run_id")
    return fixture_trades(fx).select("*", runs)


def run_sql(prefix: str) -> str:
    return f"SELECT run_id, {', '.join(RUN_COUNTS)}, {q6s(*RUN_NUMBERS)} FROM {prefix}_summary"


@query("capacity_replay", "book_summary", sql=run_sql("book"))
def _(fx):
    return realised_curve(books(fx), RISK).summary.select("run_id", *RUN_COUNTS, *rounded(*RUN_NUMBERS))


@query(
    "replay_curve",
    "book_curve",
    sql=f"SELECT run_id, CAST(d AS VARCHAR) AS date, CAST(x AS INT) AS exit_minute, n_closed, {q6s('equity', 'drawdown')} FROM book_curve",
)
def _(fx):
    curve = realised_curve(books(fx), RISK).exits
    return curve.select("run_id", day(), "exit_minute", "n_closed", *rounded("equity", "drawdown"))


# ---- forecast metrics -----------------------------------------------------------------------------------------


def pinball_sql(prediction: str, q: float) -> str:
    return f"avg(greatest({q} * (fwd_ret_15m - {prediction}), ({q} - 1) * (fwd_ret_15m - {prediction})))"


def forecast_sql(source: str, keys: str) -> str:
    parts = [f"{pinball_sql(f'q{p}', p / 100)} AS pinball_q{p}" for p in (10, 50, 90)]
    parts += [f"{pinball_sql('0', p / 100)} AS baseline_pinball_q{p}" for p in (10, 50, 90)]
    return f"""SELECT *, pinball_q50 / nullif(baseline_pinball_q50, 0) AS pinball_q50_vs_baseline FROM (
SELECT {keys}, count(*) AS n_rows, {', '.join(parts)},
  avg(CASE WHEN fwd_ret_15m >= q10 AND fwd_ret_15m <= q90 THEN 1.0 ELSE 0.0 END) AS coverage_80,
  avg(q90 - q10) AS interval_width, avg(abs(fwd_ret_15m - q50)) AS median_mae,
  avg(CASE WHEN fwd_ret_15m <> 0 THEN CASE WHEN sign(q50) = sign(fwd_ret_15m) THEN 1.0 ELSE 0.0 END END) AS direction_accuracy
FROM {source} WHERE fwd_ret_15m IS NOT NULL GROUP BY {keys})"""


@view("forecasts", "fx_pred")
def _forecasts():
    return forecast_sql("(SELECT * FROM fx_pred WHERE q10 IS NOT NULL)", "ticker")


@query("forecast_metrics", "forecasts", sql=f"SELECT ticker, n_rows, {q6s(*FORECAST_METRICS)} FROM forecasts")
def _(fx):
    rows = predictions(fx).filter(F.col("q10").isNotNull())
    return forecast_metrics(rows, "ticker").select("ticker", "n_rows", *rounded(*FORECAST_METRICS))


# ---- class probabilities both engines can state: smoothed label frequencies of the ticker's earlier sessions --


@view("fx_proba", "labelled", "snapshots")
def _proba():
    past = "OVER (PARTITION BY l.ticker ORDER BY l.d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    p = ", ".join(f"(count(CASE WHEN l.label = '{x}' THEN 1 END) {past} + 1.0) / (count(*) {past} + 3.0) AS p_{x}" for x in LABELS)
    return f"""SELECT *, 0.40 * p_opening_only + 1.00 * p_sustained AS opportunity_score FROM (
SELECT l.ticker, l.d, l.label, s.gap, s.pm_vol_ratio, {p} FROM labelled l
JOIN snapshots s ON s.ticker = l.ticker AND s.d = l.d)"""


def probabilities(fx: Fixture) -> DataFrame:
    past = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    snaps = build_snapshot_features(fx.bars, fx.calendar).select("ticker", "date", "gap", "pm_vol_ratio")
    labels = fixture_labels(fx).labels.select("ticker", "date", "label").join(snaps, ["ticker", "date"])
    n = F.count(F.lit(1)).over(past)
    p = {f"p_{x}": (F.count_if(F.col("label") == x).over(past) + 1.0) / (n + 3.0) for x in LABELS}
    return labels.withColumns(p).withColumn("opportunity_score", linear_score())


CLASSES = ("log_loss", "brier", "accuracy", "log_loss_prior", *(f"{m}_{x}" for x in LABELS for m in ("precision", "recall")))


@view("fx_prior", "labelled")
def _prior():
    return "SELECT " + ", ".join(f"avg(CASE WHEN label = '{x}' THEN 1.0 ELSE 0.0 END) AS prior_{x}" for x in LABELS) + " FROM labelled"


@view("class_metrics", "fx_proba")
def _class_metrics():
    pick = "CASE label " + " ".join(f"WHEN '{x}' THEN {{0}}_{x}" for x in LABELS) + " END"
    hat = """CASE WHEN p_none >= p_opening_only AND p_none >= p_sustained THEN 'none'
      WHEN p_opening_only >= p_sustained THEN 'opening_only' ELSE 'sustained' END"""
    brier = " + ".join(f"(p_{x} - CASE WHEN label = '{x}' THEN 1 ELSE 0 END) ** 2" for x in LABELS)
    rates = ", ".join(
        f"count(CASE WHEN hat = '{x}' AND label = '{x}' THEN 1 END) / greatest(count(CASE WHEN hat = '{x}' THEN 1 END), 1) AS precision_{x}, "
        f"count(CASE WHEN hat = '{x}' AND label = '{x}' THEN 1 END) / greatest(count(CASE WHEN label = '{x}' THEN 1 END), 1) AS recall_{x}"
        for x in LABELS
    )
    priors = ", ".join(f"avg(CASE WHEN label = '{x}' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY ticker) AS prior_{x}" for x in LABELS)
    return f"""SELECT ticker, count(*) AS n_rows, avg(-ln({pick.format("p")})) AS log_loss, avg({brier}) AS brier,
  avg(CASE WHEN hat = label THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(-ln(greatest({pick.format("prior")}, 1e-9))) AS log_loss_prior, {rates}
FROM (SELECT *, {hat} AS hat, {priors} FROM fx_proba) GROUP BY ticker"""


@query("classifier_metrics", "class_metrics", sql=f"SELECT ticker, n_rows, {q6s(*CLASSES)} FROM class_metrics")
def _(fx):
    rows = probabilities(fx)
    with_prior = rows.join(class_prior(rows, "ticker"), "ticker")
    return classifier_metrics(with_prior, "ticker").select("ticker", "n_rows", *rounded(*CLASSES))


@query("class_prior", "fx_prior", sql=f"SELECT {q6s(*(f'prior_{x}' for x in LABELS))} FROM fx_prior")
def _(fx):
    return class_prior(fixture_labels(fx).labels).select(*rounded(*(f"prior_{x}" for x in LABELS)))


@query(
    "opportunity_score",
    "fx_proba",
    sql=f"SELECT {DAY_KEY}, {q6s('opportunity_score')}, {q6('ln(greatest(p_sustained, 1e-9))')} AS log_p,"
    " CAST(CASE WHEN p_none >= p_opening_only AND p_none >= p_sustained THEN 0 WHEN p_opening_only >= p_sustained THEN 1 ELSE 2 END AS INT) AS best,"
    " CAST(CASE WHEN p_none >= 0.6 THEN 1 ELSE 0 END AS INT) AS sure FROM fx_proba",
)
def _(fx):
    return probabilities(fx).select(
        "ticker",
        day(),
        *rounded("opportunity_score"),
        r6(log_probability(F.col("p_sustained"))).alias("log_p"),
        argmax_index("p_none", "p_opening_only", "p_sustained").alias("best"),
        threshold_flag(F.col("p_none")).alias("sure"),
    )


@view("ranked_rows", "fx_proba")
def _ranked_rows():
    chance = "CAST(concat('0x', substr(md5(concat(ticker, '|', CAST(d AS VARCHAR), '|0')), 1, 8)) AS BIGINT) / 4294967296.0"
    scores = {"model": "opportunity_score", "gap": "abs(gap)", "pm_vol": "pm_vol_ratio", "random": chance}
    return "\nUNION ALL ".join(f"SELECT '{n}' AS ranker, ticker, d, label, {e} AS score FROM fx_proba" for n, e in scores.items())


@view("rank_days", "ranked_rows")
def _rank_days():
    return f"""SELECT ranker, d, count(CASE WHEN nth <= {K} AND label <> 'none' THEN 1 END) AS hits,
  count(CASE WHEN label <> 'none' THEN 1 END) AS n_opps, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY ranker, d ORDER BY score DESC NULLS LAST, ticker) AS nth FROM ranked_rows)
GROUP BY ranker, d"""


RANK = f"{q6(f'avg(hits / least({K}, n))')} AS p_at_{K}, {q6(f'avg(CASE WHEN n_opps > 0 THEN hits / least(n_opps, {K}) END)')} AS capture_at_{K}"


@query("compare_rankers", "rank_days", sql=f"SELECT ranker, {RANK} FROM rank_days GROUP BY ranker")
def _(fx):
    return compare_rankers(probabilities(fx), K).select("ranker", *rounded(f"p_at_{K}", f"capture_at_{K}"))


@query("ranking_metrics", "rank_days", sql=f"SELECT {RANK} FROM rank_days WHERE ranker = 'model'")
def _(fx):
    return ranking_metrics(probabilities(fx), "opportunity_score", K).select(*rounded(f"p_at_{K}", f"capture_at_{K}"))


@query(
    "precision_score",
    "targets",
    sql=f"""SELECT {q6("count(CASE WHEN called = 1 AND target = 1 THEN 1 END) / count(CASE WHEN called = 1 THEN 1 END)")} AS precision,
  count(CASE WHEN called = 1 THEN 1 END) AS n_called, count(*) AS n_rows
FROM (SELECT *, CASE WHEN close < open THEN 1 ELSE 0 END AS called FROM targets)""",
)
def _(fx):
    from tapeworks.operators.trend import next_day_target

    rows = next_day_target(fx.daily).withColumn("called", (F.col("close") < F.col("open")).cast("int"))
    return precision_score(rows, "target", "called").select(*rounded("precision"), "n_called", "n_rows")


@query("label_index", "labelled", sql=f"""SELECT {DAY_KEY}, CAST(CASE label WHEN 'none' THEN 0 WHEN 'opening_only' THEN 1 ELSE 2 END AS INT) AS y,
  {q6("CASE label WHEN 'none' THEN 1 ELSE 0 END")} AS is_none FROM labelled""")
def _(fx):
    labels = fixture_labels(fx).labels
    return labels.select("ticker", day(), label_index(F.col("label")).alias("y"), r6((F.col("label") == "none").cast("double")).alias("is_none"))


# ---- candidates ------------------------------------------------------------------------------------------------


@view("gap_scores", "snapshots")
def _gap_scores():
    return "SELECT ticker, d, abs(gap) AS score FROM snapshots"


@query(
    "select_candidates",
    "gap_scores",
    sql=f"SELECT {DAY_KEY}, {q6s('score')} FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, ticker) AS nth"
    f" FROM gap_scores WHERE score >= 0.02) WHERE nth <= {K}",
)
def _(fx):
    return select_candidates(gap_scores(fx), 0.02, K).select("ticker", day(), *rounded("score"))


@query("watchlist", "gap_scores", sql=f"SELECT {DAY_KEY}, {q6s('score')} FROM gap_scores WHERE score >= 0.05")
def _(fx):
    return select_candidates(gap_scores(fx), 0.05, None).select("ticker", day(), *rounded("score"))


def gap_scores(fx: Fixture) -> DataFrame:
    snaps = build_snapshot_features(fx.bars, fx.calendar)
    return snaps.select("ticker", "date", F.abs("gap").alias("score"))


# ---- arms and slices ------------------------------------------------------------------------------------------


@view("fold_watchlist", "gap_scores", "folds")
def _fold_watchlist():
    return "SELECT f.fold_id, g.ticker, g.d FROM gap_scores g JOIN folds f ON f.d = g.d AND f.segment = 'test' WHERE g.score >= 0.05"


@view("arms", "orb_trades", "fold_watchlist", "folds")
def _arms():
    base = """SELECT f.fold_id, t.ticker, t.d, t.m, CASE t.direction WHEN 1 THEN 'long' ELSE 'short' END AS direction,
  t.gross AS gross_ret, t.net AS net_ret, t.q10, t.entry_m, t.exit_m, '{0}' AS arm
FROM orb_trades t JOIN folds f ON f.d = t.d AND f.segment = 'test'"""
    gate = " WHERE EXISTS (SELECT 1 FROM fold_watchlist w WHERE w.fold_id = f.fold_id AND w.ticker = t.ticker AND w.d = t.d)"
    return base.format("pure") + " UNION ALL " + base.format("gated") + gate


@view("arm_summaries", "arms", "folds")
def _arm_summaries():
    universe = """SELECT fold_id, arm, 1 AS n_decision_rows, count(DISTINCT d) AS n_days
  FROM folds, (SELECT unnest(['pure', 'gated']) AS arm) WHERE segment = 'test' GROUP BY fold_id, arm"""
    return summary_sql("arms", universe, "fold_id, arm", "s.fold_id = u.fold_id AND s.arm = u.arm")


def fixture_arms(fx: Fixture) -> tuple[DataFrame, DataFrame]:
    folds = fixture_folds(fx)
    test = folds.filter(F.col("segment") == TEST)
    listed = tag_folds(select_candidates(gap_scores(fx), 0.05, None), test)
    return arm_trades(fx.rth, listed, folds, BREAKOUT), folds


ARM_NUMBERS = [c for c in NUMBERS if c != "hold_fraction"]


@query("arm_compare", "arm_summaries", sql=f"SELECT fold_id, arm, n_trades, n_long, n_short, {q6s(*ARM_NUMBERS)} FROM arm_summaries")
def _(fx):
    trades, folds = fixture_arms(fx)
    return arm_compare(trades, folds).select("fold_id", "arm", "n_trades", "n_long", "n_short", *rounded(*ARM_NUMBERS))


curve_views(
    "arm",
    "SELECT arm AS run_id, d, CAST(entry_m AS INT) AS entry, CAST(exit_m AS INT) AS exit_m, net_ret, q10 FROM arms",
    "SELECT unnest(['pure', 'gated']) AS run_id",
    "arms",
)


@query("arm_replay", "arm_summary", sql=run_sql("arm"))
def _(fx):
    return arm_curves(fixture_arms(fx)[0], RISK).summary.select("run_id", *RUN_COUNTS, *rounded(*RUN_NUMBERS))


# Breakout exits can fall on the entry bar, and all tickers share the book.
curve_views(
    "orb",
    "SELECT 'orb' AS run_id, d, CAST(entry_m AS INT) AS entry, CAST(exit_m AS INT) AS exit_m, net AS net_ret, q10 FROM orb_trades",
    "SELECT 'orb' AS run_id",
    "orb_trades",
)


@query("breakout_replay", "orb_summary", sql=run_sql("orb"))
def _(fx):
    trades = run_breakout(fx.rth, BREAKOUT).withColumn("run_id", F.lit("orb"))
    return realised_curve(trades, RISK).summary.select("run_id", *RUN_COUNTS, *rounded(*RUN_NUMBERS))


@view("sliced", "fx_pred", "folds", "fold_watchlist")
def _sliced():
    decided = decide_sql("(SELECT p.*, f.fold_id FROM fx_pred p JOIN folds f ON f.d = p.d AND f.segment = 'test')", DECISION)
    return f"""SELECT r.*, 'all' AS slice FROM ({decided}) r
UNION ALL SELECT r.*, 'cand' FROM ({decided}) r WHERE EXISTS (SELECT 1 FROM fold_watchlist w
  WHERE w.fold_id = r.fold_id AND w.ticker = r.ticker AND w.d = r.d)"""


@view("slice_forecasts", "sliced")
def _slice_forecasts():
    return forecast_sql("sliced", "fold_id, slice")


@view("slice_trades", "sliced", "thinned")
def _slice_trades():
    return """SELECT s.fold_id, s.slice, t.* FROM thinned t
JOIN (SELECT DISTINCT fold_id, slice, ticker, d FROM sliced) s ON s.ticker = t.ticker AND s.d = t.d"""


@view("slice_summaries", "slice_trades", "sliced")
def _slice_summaries():
    universe = "SELECT fold_id, slice, count(*) AS n_decision_rows, count(DISTINCT d) AS n_days FROM sliced GROUP BY fold_id, slice"
    return summary_sql("slice_trades", universe, "fold_id, slice", "s.fold_id = u.fold_id AND s.slice = u.slice")


def fixture_slices(fx: Fixture) -> tuple[DataFrame, DataFrame]:
    test = fixture_folds(fx).filter(F.col("segment") == TEST)
    rows = tag_folds(predictions(fx), test)
    listed = tag_folds(select_candidates(gap_scores(fx), 0.05, None), test)
    return slice_ablation(rows, listed, COSTS, DECISION)


@query("slice_forecasts", "slice_forecasts", sql=f"SELECT fold_id, slice, n_rows, {q6s(*FORECAST_METRICS)} FROM slice_forecasts")
def _(fx):
    return fixture_slices(fx)[0].select("fold_id", "slice", "n_rows", *rounded(*FORECAST_METRICS))


@query("slice_trades", "slice_summaries", sql=f"SELECT fold_id, slice, n_trades, n_long, n_short, {q6s(*NUMBERS)} FROM slice_summaries")
def _(fx):
    return fixture_slices(fx)[1].select("fold_id", "slice", "n_trades", "n_long", "n_short", *rounded(*NUMBERS))


FOLD_METRICS = ("frac_none", "frac_opening_only", "frac_sustained", "qualify_rate")


@query(
    "across_folds",
    "stability",
    sql="\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, {q6(f'avg({m})')} AS mean, {q6(f'coalesce(stddev_samp({m}), 0)')} AS stdev, count({m}) AS n_folds FROM stability"
        for m in FOLD_METRICS
    ),
)
def _(fx):
    return across_folds(fixture_stability(fx), *FOLD_METRICS).select("metric", *rounded("mean", "stdev"), "n_folds")
