"""Breakout and sweep strategies: ranges, ATR, signals, exits, compounding and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.config import CostModel
from tapeworks.operators import breakout as orb
from tapeworks.operators import sweep as swp
from tapeworks.operators.asof import daily_bars
from tapeworks.operators.sweep_stats import best_setting, buy_and_hold, with_drawdown
from tapeworks.plans.sweep_study import PAIR_COST, SETTINGS, grid_trades, strategy_sweep

from .fixtures import BREAKOUT, Fixture
from .registry import day, q6, q6s, query, rounded, view

KEY = "ticker, CAST(d AS VARCHAR) AS date, CAST(m AS INT) AS minute"
DAY_KEY = "ticker, CAST(d AS VARCHAR) AS date"
COST = CostModel().round_trip_cost
END = 570 + BREAKOUT.range_minutes


@view("orb_range", "fx_rth")
def _range():
    return f"""SELECT ticker, d, max(high) AS range_high, min(low) AS range_low
FROM fx_rth WHERE m >= 570 AND m < {END} GROUP BY ticker, d"""


@view("orb_atr", "fx_rth")
def _atr():
    return """SELECT ticker, d, lag(tr, 1) OVER (PARTITION BY ticker ORDER BY d) AS atr FROM (
  SELECT ticker, d, avg(greatest(high - low, abs(high - pc), abs(low - pc))) AS tr
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker, d ORDER BY m) AS pc FROM fx_rth) GROUP BY ticker, d)"""


# Three-session look-back: the previous-close chain restarts at the first bar of each look-back.
@view("orb_atr3", "fx_rth")
def _atr3():
    return """SELECT t.ticker, t.d, avg(greatest(b.high - b.low, abs(b.high - b.pc), abs(b.low - b.pc))) AS atr
FROM (SELECT DISTINCT ticker, d, dense_rank() OVER (PARTITION BY ticker ORDER BY d) AS i FROM fx_rth) t
LEFT JOIN (SELECT f.*, k.t_first, CASE WHEN f.j = k.t_first AND f.n = 1 THEN NULL ELSE f.prev END AS pc FROM (
        SELECT r.*, dense_rank() OVER (PARTITION BY ticker ORDER BY d) AS j, row_number() OVER (PARTITION BY ticker, d ORDER BY m) AS n,
          lag(close) OVER (PARTITION BY ticker ORDER BY d, m) AS prev FROM fx_rth r) f,
        (SELECT unnest(generate_series(1, 400)) AS t_first) k WHERE k.t_first <= f.j AND f.j < k.t_first + 3) b
  ON b.ticker = t.ticker AND b.t_first = t.i - 3
GROUP BY t.ticker, t.d"""


@view("orb_bars", "fx_rth", "orb_range", "orb_atr")
def _orb_bars():
    return """SELECT b.*, r.range_high, r.range_low, a.atr,
  quantile_cont(volume, 0.5) OVER (PARTITION BY b.ticker, b.d ORDER BY b.m ROWS UNBOUNDED PRECEDING) AS median_volume
FROM fx_rth b LEFT JOIN orb_range r ON r.ticker = b.ticker AND r.d = b.d
LEFT JOIN orb_atr a ON a.ticker = b.ticker AND a.d = b.d"""


@view("orb_signals", "orb_bars")
def _orb_signals():
    return f"""SELECT *, close - direction * {BREAKOUT.stop_atr_mult} * atr AS stop,
  close + direction * {BREAKOUT.rr} * abs(close - (close - direction * {BREAKOUT.stop_atr_mult} * atr)) AS target
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, d ORDER BY m) AS nth FROM (
  SELECT *, CASE WHEN close >= range_high + {BREAKOUT.min_break_atr} * atr THEN 1
                 WHEN close <= range_low - {BREAKOUT.min_break_atr} * atr THEN -1 END AS direction
  FROM orb_bars WHERE m >= {END} AND atr > 0 AND volume >= {BREAKOUT.vol_mult} * median_volume)
  WHERE direction IS NOT NULL) WHERE nth = 1"""


def trades_sql(entry_stop: str) -> str:
    return f"""SELECT ticker, d, m, direction, entry, stop, target, entry_m, risk, q10, exit_px, exit_reason, exit_m,
  direction * (exit_px - entry) / entry AS gross, direction * (exit_px - entry) / entry - {COST} AS net FROM (
SELECT e.*, -risk / entry AS q10, coalesce(x.px, l.close) AS exit_px, coalesce(x.reason, 'time') AS exit_reason,
  coalesce(x.m, l.m) AS exit_m
FROM ({entry_stop}) e
LEFT JOIN LATERAL (SELECT b.m, CASE WHEN e.stop BETWEEN b.low AND b.high THEN e.stop ELSE e.target END AS px,
    CASE WHEN e.stop BETWEEN b.low AND b.high THEN 'stop' ELSE 'target' END AS reason
  FROM fx_rth b WHERE b.ticker = e.ticker AND b.d = e.d AND b.m >= e.entry_m
    AND (e.stop BETWEEN b.low AND b.high OR e.target BETWEEN b.low AND b.high) ORDER BY b.m LIMIT 1) x ON true
LEFT JOIN LATERAL (SELECT b.m, b.close FROM fx_rth b WHERE b.ticker = e.ticker AND b.d = e.d
    ORDER BY b.m DESC LIMIT 1) l ON true)"""


@view("orb_entries", "orb_signals", "fx_rth")
def _orb_entries():
    return f"""SELECT s.ticker, s.d, s.m, s.direction, n.m AS entry_m, n.open AS entry,
  n.open - s.direction * {BREAKOUT.stop_atr_mult} * s.atr AS stop,
  abs(n.open - (n.open - s.direction * {BREAKOUT.stop_atr_mult} * s.atr)) AS risk,
  n.open + s.direction * {BREAKOUT.rr} * abs(n.open - (n.open - s.direction * {BREAKOUT.stop_atr_mult} * s.atr)) AS target
FROM orb_signals s JOIN LATERAL (SELECT b.m, b.open FROM fx_rth b WHERE b.ticker = s.ticker AND b.d = s.d
  AND b.m > s.m ORDER BY b.m LIMIT 1) n ON true"""


@view("orb_trades", "orb_entries", "fx_rth")
def _orb_trades():
    return trades_sql("SELECT * FROM orb_entries WHERE risk > 0")


# A gate that both engines can state: sessions whose overnight gap is known and upward.
@view("orb_gate", "session_gaps")
def _orb_gate():
    return "SELECT ticker, d FROM session_gaps WHERE overnight_gap > 0"


TRADE_NUMBERS = ("gross_ret", "net_ret", "q10", "entry", "stop", "target", "exit")
TRADE_OUT = (
    f"{KEY}, CASE direction WHEN 1 THEN 'long' ELSE 'short' END AS direction, "
    f"{q6('gross')} AS gross_ret, {q6('net')} AS net_ret, {q6('exit_px')} AS exit, {q6s('q10', 'entry', 'stop', 'target')}, "
    "CAST(entry_m AS INT) AS entry_minute, CAST(exit_m AS INT) AS exit_minute, exit_reason"
)


def trade_columns() -> list:
    return ["ticker", day(), "minute", "direction", *rounded(*TRADE_NUMBERS), "entry_minute", "exit_minute", "exit_reason"]


@query("opening_range", "fx_rth", "orb_range", sql=f"""SELECT b.ticker, CAST(b.d AS VARCHAR) AS date, b.m AS minute,
  {q6s('range_high', 'range_low')} FROM fx_rth b LEFT JOIN orb_range r ON r.ticker = b.ticker AND r.d = b.d""")
def _(fx):
    return orb.opening_range(fx.rth).select("ticker", day(), "minute", *rounded("range_high", "range_low"))


@query("prior_session_atr", "orb_atr", sql=f"SELECT {DAY_KEY}, {q6s('atr')} FROM orb_atr")
def _(fx):
    return orb.prior_session_atr(fx.rth, 1).select("ticker", day(), *rounded("atr"))


@query("prior_three_sessions_atr", "orb_atr3", sql=f"SELECT {DAY_KEY}, {q6s('atr')} FROM orb_atr3")
def _(fx):
    return orb.prior_session_atr(fx.rth, 3).select("ticker", day(), *rounded("atr"))


@query("running_volume_median", "orb_bars", sql=f"SELECT {KEY}, {q6s('median_volume')} FROM orb_bars")
def _(fx):
    return orb.running_volume_median(fx.rth).select("ticker", day(), "minute", *rounded("median_volume"))


@query(
    "breakout_signals",
    "orb_signals",
    sql=f"SELECT {DAY_KEY}, m AS signal_minute, direction, {q6s('range_high', 'range_low', 'atr', 'stop', 'target')}, "
    f"{q6('close')} AS entry_ref FROM orb_signals",
)
def _(fx):
    numbers = ("range_high", "range_low", "atr", "entry_ref", "stop", "target")
    return orb.breakout_signals(fx.rth, BREAKOUT).select("ticker", day(), "signal_minute", "direction", *rounded(*numbers))


@query("run_breakout", "orb_trades", sql=f"SELECT {TRADE_OUT} FROM orb_trades WHERE exit_px IS NOT NULL")
def _(fx):
    return orb.run_breakout(fx.rth, BREAKOUT).select(*trade_columns())


def gap_gate(fx: Fixture):
    from tapeworks.operators.intraday import overnight_gaps

    return overnight_gaps(fx.rth).filter(F.col("overnight_gap") > 0)


@query(
    "run_breakout_gated",
    "orb_trades",
    "orb_gate",
    sql=f"SELECT {TRADE_OUT} FROM orb_trades t WHERE EXISTS (SELECT 1 FROM orb_gate g WHERE g.ticker = t.ticker AND g.d = t.d)",
)
def _(fx):
    return orb.run_breakout(fx.rth, BREAKOUT, gate=gap_gate(fx)).select(*trade_columns())


@query(
    "candidate_semi_join",
    "fx_rth",
    "orb_gate",
    sql="SELECT b.ticker, CAST(b.d AS VARCHAR) AS date, count(*) AS n_bars FROM fx_rth b"
    " SEMI JOIN orb_gate g ON g.ticker = b.ticker AND g.d = b.d GROUP BY b.ticker, b.d",
)
def _(fx):
    kept = fx.rth.join(gap_gate(fx).select("ticker", "date"), ["ticker", "date"], "left_semi")
    return kept.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n_bars")).select("ticker", day(), "n_bars")


# ---- sweep ----------------------------------------------------------------------------------------------------


@view("all_days", "fx_bars")
def _all_days():
    return """SELECT ticker, d, min_by(open, m) AS open, max(high) AS high, min(low) AS low, max_by(close, m) AS close,
  sum(volume) AS volume FROM fx_bars GROUP BY ticker, d"""


@view("day_levels", "all_days")
def _day_levels():
    return """SELECT ticker, d, lag(high) OVER t AS pdh, lag(low) OVER t AS pdl FROM all_days
WINDOW t AS (PARTITION BY ticker ORDER BY d)"""


@view("zone", "fx_bars", "day_levels")
def _zone():
    return """SELECT * FROM (SELECT b.ticker, b.d, b.m, b.high, b.low, b.close, l.pdh, l.pdl,
  CAST(row_number() OVER (PARTITION BY b.ticker, b.d ORDER BY b.m) - 1 AS INT) AS i, count(*) OVER (PARTITION BY b.ticker, b.d) AS n
FROM fx_bars b JOIN day_levels l ON l.ticker = b.ticker AND l.d = b.d WHERE b.m BETWEEN 570 AND 720 AND l.pdh IS NOT NULL)
WHERE n >= 7"""


@view("zone_swings", "zone")
def _zone_swings():
    near = ", ".join(
        f"{fn}({c}, {k}) OVER s AS {c}_{fn}{k}" for c in ("high", "low") for fn in ("lag", "lead") for k in (1, 2)
    )

    def beyond(c: str, op: str) -> str:
        sides = " AND ".join(f"{c} {op} {c}_{fn}{k}" for fn in ("lag", "lead") for k in (1, 2))
        return f"coalesce({sides}, false)"

    return f"""SELECT ticker, d, m, i, high, low, {beyond("high", ">")} AS is_high, {beyond("low", "<")} AS is_low,
  CASE WHEN low_lead1 > high_lag1 THEN 'bull' WHEN high_lead1 < low_lag1 THEN 'bear' END AS fvg,
  CASE WHEN low_lead1 > high_lag1 THEN high_lag1 WHEN high_lead1 < low_lag1 THEN high_lead1 END AS fvg_bottom,
  CASE WHEN low_lead1 > high_lag1 THEN low_lead1 WHEN high_lead1 < low_lag1 THEN low_lag1 END AS fvg_top
FROM (SELECT *, {near} FROM zone WINDOW s AS (PARTITION BY ticker, d ORDER BY i))"""


@view("zone_sweeps", "zone")
def _zone_sweeps():
    return """SELECT *, CASE WHEN low < pdl AND (i = 0 OR lag(low) OVER s >= pdl) THEN 1
  WHEN high > pdh AND (i = 0 OR lag(high) OVER s <= pdh) THEN -1 END AS dir
FROM zone WINDOW s AS (PARTITION BY ticker, d ORDER BY i)"""


@view("zone_reclaims", "zone_sweeps", "zone")
def _zone_reclaims():
    return """SELECT c.ticker, c.d, c.i, c.dir, c.pdh, c.pdl, CASE c.dir WHEN 1 THEN c.low ELSE c.high END AS extreme,
  min(b.i) AS reclaim
FROM zone_sweeps c JOIN zone b ON b.ticker = c.ticker AND b.d = c.d AND b.i BETWEEN c.i AND c.i + 6
  AND CASE c.dir WHEN 1 THEN b.close > c.pdl ELSE b.close < c.pdh END
WHERE c.dir IS NOT NULL GROUP BY ALL"""


# For every later bar: the newest swing since the poke that the bar could know, then the first bar that breaks it.
@view("zone_shifts", "zone_reclaims", "zone_swings", "zone")
def _zone_shifts():
    return """SELECT * FROM (SELECT r.*, b.i AS k, b.m AS signal_m, b.close AS shift_close, w.ref,
  row_number() OVER (PARTITION BY r.ticker, r.d, r.i ORDER BY b.i) AS nth
FROM zone_reclaims r JOIN zone b ON b.ticker = r.ticker AND b.d = r.d AND b.i > r.reclaim
JOIN LATERAL (SELECT s.i AS ref, CASE r.dir WHEN 1 THEN s.high ELSE s.low END AS level FROM zone_swings s
  WHERE s.ticker = r.ticker AND s.d = r.d AND s.i >= r.i AND s.i + 2 <= b.i - 1
    AND CASE r.dir WHEN 1 THEN s.is_high ELSE s.is_low END ORDER BY s.i DESC LIMIT 1) w ON true
WHERE CASE r.dir WHEN 1 THEN b.close > w.level ELSE b.close < w.level END) WHERE nth = 1"""


@view("zone_entries", "zone_shifts", "zone_swings")
def _zone_entries():
    return """SELECT *, extreme - dir * 0.05 * abs(entry - extreme) AS stop FROM (
SELECT h.*, coalesce(g.px, h.shift_close) AS entry, g.px IS NOT NULL AS used_fvg FROM zone_shifts h
LEFT JOIN LATERAL (SELECT CASE h.dir WHEN 1 THEN s.fvg_bottom ELSE s.fvg_top END AS px FROM zone_swings s
  WHERE s.ticker = h.ticker AND s.d = h.d AND s.i > h.ref AND s.i < h.k
    AND s.fvg = CASE h.dir WHEN 1 THEN 'bull' ELSE 'bear' END ORDER BY s.i DESC LIMIT 1) g ON true)
WHERE abs(entry - extreme) > 0"""


@view("zone_setups", "zone_entries")
def _zone_setups():
    settings = ", ".join(
        f"('{c.setting}', {c.rr if c.target_mode == 'fixed_rr' else 'CAST(NULL AS DOUBLE)'})" for c in SETTINGS
    )
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setting, ticker, d ORDER BY i) AS first FROM (
  SELECT e.*, c.setting, coalesce(e.entry + e.dir * c.rr * abs(e.entry - e.stop), CASE e.dir WHEN 1 THEN e.pdh ELSE e.pdl END) AS target
  FROM zone_entries e, (VALUES {settings}) AS c(setting, rr)) WHERE dir * (target - entry) > 0) WHERE first = 1"""


@view("sweep_trades", "zone_setups", "fx_bars")
def _sweep_trades():
    return f"""SELECT *, (dir * (exit_px - entry) - 2 * CASE ticker WHEN 'SPY' THEN {PAIR_COST} ELSE {swp.STOCK_COST} END) / abs(entry - stop) AS r FROM (
SELECT e.*, f.m AS fill_m, coalesce(x.px, l.close) AS exit_px, coalesce(x.reason, 'time') AS exit_reason,
  coalesce(x.m, l.m) AS exit_m FROM zone_setups e
JOIN LATERAL (SELECT b.m FROM fx_bars b WHERE b.ticker = e.ticker AND b.d = e.d AND b.m > e.signal_m
    AND e.entry BETWEEN b.low AND b.high ORDER BY b.m LIMIT 1) f ON true
LEFT JOIN LATERAL (SELECT b.m, CASE WHEN e.stop BETWEEN b.low AND b.high THEN e.stop ELSE e.target END AS px,
    CASE WHEN e.stop BETWEEN b.low AND b.high THEN 'stop' ELSE 'target' END AS reason
  FROM fx_bars b WHERE b.ticker = e.ticker AND b.d = e.d AND b.m >= f.m
    AND (e.stop BETWEEN b.low AND b.high OR e.target BETWEEN b.low AND b.high) ORDER BY b.m LIMIT 1) x ON true
LEFT JOIN LATERAL (SELECT b.m, b.close FROM fx_bars b WHERE b.ticker = e.ticker AND b.d = e.d ORDER BY b.m DESC LIMIT 1) l ON true)"""


@view("sweep_equity", "sweep_trades")
def _sweep_equity():
    return """SELECT *, 10000.0 * product(1 + 0.01 * r) OVER w AS equity,
  10000.0 * product(1 + 0.01 * r) OVER w - 10000.0 * coalesce(product(1 + 0.01 * r) OVER p, 1) AS pnl
FROM sweep_trades WINDOW w AS (PARTITION BY setting, ticker ORDER BY d ROWS UNBOUNDED PRECEDING),
  p AS (PARTITION BY setting, ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@view("sweep_drawdown", "sweep_equity")
def _sweep_drawdown():
    return """SELECT *, equity / greatest(10000.0, max(equity) OVER (PARTITION BY setting, ticker ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1
  AS drawdown FROM sweep_equity"""


@view("sweep_stats", "sweep_drawdown")
def _sweep_stats():
    return """SELECT setting, ticker, count(*) AS trades, count(CASE WHEN pnl > 0 THEN 1 END) AS wins,
  count(CASE WHEN pnl < 0 THEN 1 END) AS losses, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
  coalesce(avg(CASE WHEN pnl > 0 THEN r END), 0) AS avg_win_r, coalesce(avg(CASE WHEN pnl < 0 THEN r END), 0) AS avg_loss_r,
  avg(r) AS expectancy_r,
  CASE WHEN coalesce(-sum(CASE WHEN pnl < 0 THEN pnl END), 0) > 0
    THEN coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) / -sum(CASE WHEN pnl < 0 THEN pnl END)
    ELSE CAST('inf' AS DOUBLE) END AS profit_factor,
  sum(pnl) AS total_pnl, sum(pnl) / 10000.0 * 100 AS total_return_pct, 10000.0 + sum(pnl) AS end_equity,
  least(min(drawdown), 0) * 100 AS max_drawdown_pct, avg(CASE WHEN used_fvg THEN 1.0 ELSE 0.0 END) AS fvg_share,
  count(CASE WHEN exit_reason = 'target' THEN 1 END) AS target_hits,
  count(CASE WHEN exit_reason = 'stop' THEN 1 END) AS stop_hits,
  count(CASE WHEN exit_reason = 'time' THEN 1 END) AS time_exits
FROM sweep_drawdown GROUP BY setting, ticker"""


def zone_bars(fx: Fixture):
    zone = swp.bar_index(fx.bars.filter(F.col("minute").between(570, 720)))
    return swp.with_prior_levels(zone, daily_bars(fx.bars))


@query("swings", "zone_swings", sql=f"SELECT {KEY}, is_high AS is_swing_high, is_low AS is_swing_low FROM zone_swings")
def _(fx):
    enough = F.count(F.lit(1)).over(swp.whole_session()) >= 7
    rows = swp.swings(zone_bars(fx).withColumn("enough", enough).filter("enough"))
    return rows.select("ticker", day(), "minute", "is_swing_high", "is_swing_low")


@query("fair_value_gaps", "zone_swings", sql=f"SELECT {KEY}, fvg, {q6s('fvg_bottom', 'fvg_top')} FROM zone_swings WHERE fvg IS NOT NULL")
def _(fx):
    enough = F.count(F.lit(1)).over(swp.whole_session()) >= 7
    rows = swp.fair_value_gaps(zone_bars(fx).withColumn("enough", enough).filter("enough"))
    return rows.filter(F.col("fvg").isNotNull()).select("ticker", day(), "minute", "fvg", *rounded("fvg_bottom", "fvg_top"))


@query(
    "last_swing_before",
    "zone_swings",
    sql="SELECT a.ticker, CAST(a.d AS VARCHAR) AS date, a.m AS minute, max(CASE WHEN b.is_high THEN b.i END) AS last_swing_high,"
    " max(CASE WHEN b.is_low THEN b.i END) AS last_swing_low FROM zone_swings a"
    " LEFT JOIN zone_swings b ON b.ticker = a.ticker AND b.d = a.d AND b.i < a.i GROUP BY a.ticker, a.d, a.m",
)
def _(fx):
    enough = F.count(F.lit(1)).over(swp.whole_session()) >= 7
    rows = swp.last_swing_before(swp.swings(zone_bars(fx).withColumn("enough", enough).filter("enough")))
    return rows.select("ticker", day(), "minute", "last_swing_high", "last_swing_low")


@query("prior_day_levels", "day_levels", sql=f"SELECT {DAY_KEY}, {q6s('pdh', 'pdl')} FROM day_levels")
def _(fx):
    return swp.prior_day_levels(daily_bars(fx.bars)).select("ticker", day(), *rounded("pdh", "pdl"))


@query("fresh_sweeps", "zone_sweeps", sql=f"SELECT {KEY}, dir AS sweep FROM zone_sweeps WHERE dir IS NOT NULL")
def _(fx):
    enough = F.count(F.lit(1)).over(swp.whole_session()) >= 7
    rows = swp.fresh_sweeps(zone_bars(fx).withColumn("enough", enough).filter("enough"))
    return rows.filter(F.col("sweep").isNotNull()).select("ticker", day(), "minute", "sweep")


@query(
    "sweep_setups",
    "zone_setups",
    sql=f"SELECT setting, {DAY_KEY}, dir AS direction, CAST(signal_m AS INT) AS signal_minute, {q6s('entry', 'stop', 'target')}, used_fvg"
    " FROM zone_setups",
)
def _(fx):
    setups = swp.sweep_setups(swp.sweep_entries(fx.bars, daily_bars(fx.bars)), SETTINGS)
    return setups.select("setting", "ticker", day(), "direction", "signal_minute", *rounded("entry", "stop", "target"), "used_fvg")


def market_costs(fx: Fixture):
    """The market ticker is priced as a currency pair, all others as stocks."""
    market = fx.bars.filter(F.col("ticker") == "SPY").select("ticker").distinct()
    return market.withColumn("unit_cost", F.lit(PAIR_COST))


@query(
    "limit_then_touch",
    "sweep_trades",
    sql=f"SELECT setting, {DAY_KEY}, CAST(fill_m AS INT) AS fill_minute, CAST(exit_m AS INT) AS exit_minute, exit_reason, "
    f"{q6('exit_px')} AS exit, {q6('r')} AS r_multiple FROM sweep_trades",
)
def _(fx):
    trades = swp.sweep_trades(fx.bars, daily_bars(fx.bars), SETTINGS, market_costs(fx))
    return trades.select("setting", "ticker", day(), "fill_minute", "exit_minute", "exit_reason", *rounded("exit", "r_multiple"))


@query("compound_r", "sweep_equity", sql=f"SELECT setting, {DAY_KEY}, {q6s('equity', 'pnl')} FROM sweep_equity")
def _(fx):
    return grid_trades(fx.bars, costs=market_costs(fx)).select("setting", "ticker", day(), *rounded("equity", "pnl"))


@query("sweep_drawdown", "sweep_drawdown", sql=f"SELECT setting, {DAY_KEY}, {q6s('drawdown')} FROM sweep_drawdown")
def _(fx):
    return with_drawdown(grid_trades(fx.bars, costs=market_costs(fx))).select("setting", "ticker", day(), *rounded("drawdown"))


STATS = (
    "win_rate", "avg_win_r", "avg_loss_r", "expectancy_r", "profit_factor", "total_pnl", "total_return_pct", "end_equity",
    "max_drawdown_pct", "fvg_share",
)
COUNTS = "trades", "wins", "losses", "target_hits", "stop_hits", "time_exits"
FINITE = [c for c in STATS if c != "profit_factor"]
PF = "CASE WHEN isinf(profit_factor) THEN 'inf' ELSE CAST(CAST(round(profit_factor, 4) * 10000 AS BIGINT) AS VARCHAR) END"


@query(
    "strategy_sweep",
    "sweep_stats",
    sql=f"SELECT setting, ticker, {', '.join(COUNTS)}, {q6s(*FINITE)}, {PF} AS profit_factor_1e4 FROM sweep_stats",
)
def _(fx):
    stats = strategy_sweep(fx.bars, costs=market_costs(fx))
    infinite = F.col("profit_factor") == float("inf")
    shown = (F.round("profit_factor", 4) * 10000).cast("bigint").cast("string")
    return stats.select(
        "setting",
        "ticker",
        *COUNTS,
        *rounded(*FINITE),
        F.when(infinite, "inf").otherwise(shown).alias("profit_factor_1e4"),
    )


@query(
    "best_setting",
    "sweep_stats",
    sql=f"SELECT ticker, setting, {q6s('expectancy_r')} FROM (SELECT *, row_number() OVER (PARTITION BY ticker"
    " ORDER BY expectancy_r DESC, setting DESC) AS nth FROM sweep_stats) WHERE nth = 1",
)
def _(fx):
    return best_setting(strategy_sweep(fx.bars, costs=market_costs(fx))).select("ticker", "setting", *rounded("expectancy_r"))


@query(
    "buy_and_hold",
    "fx_bars",
    sql="SELECT ticker, "
    + q6("(arg_max(close, date_diff('day', DATE '2024-01-01', d) * 1440 + m) / arg_min(close, date_diff('day', DATE '2024-01-01', d) * 1440 + m) - 1) * 100")
    + " AS return_pct FROM fx_bars GROUP BY ticker",
)
def _(fx):
    return buy_and_hold(fx.bars).select("ticker", *rounded("return_pct"))
