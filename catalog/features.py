"""Clock columns, intraday bar features, pre-market snapshots, daily trend features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.config import CUTOFF_MINUTE
from tapeworks.functions.clock import in_killzone, premarket_usable, with_et
from tapeworks.functions.rolling import day_order
from tapeworks.operators import intraday as bar_ops
from tapeworks.operators import premarket as pm_ops
from tapeworks.operators.trend import next_day_target, trend_columns, trend_features

from .registry import day, q6, q6s, query, r6, rounded, view

KEY = "ticker, CAST(d AS VARCHAR) AS date, m AS minute"
DAY_KEY = "ticker, CAST(d AS VARCHAR) AS date"


@query("with_et", "fx_bars", sql=f"SELECT {KEY}, CAST(m // 15 * 15 AS INT) AS slot FROM fx_bars")
def _(fx):
    return with_et(fx.bars.drop("date", "minute")).select("ticker", day(), "minute", "slot")


@query(
    "premarket_usable",
    "fx_bars",
    sql=f"SELECT {KEY} FROM fx_bars WHERE m >= 240 AND (m + 5) * 60 + 5 <= 540 * 60",
)
def _(fx):
    return fx.bars.filter(premarket_usable(CUTOFF_MINUTE, 240, 5)).select("ticker", day(), "minute")


@query("killzone", "fx_bars", sql=f"SELECT {KEY} FROM fx_bars WHERE m >= 570 AND m <= 720")
def _(fx):
    return fx.bars.filter(in_killzone(570, 720)).select("ticker", day(), "minute")


# The oracle's feature table, written frame by frame.
@view("bar_moves", "fx_rth")
def _moves():
    return """SELECT *, ln(close / lag(close, 1) OVER s) AS r5, ln(close / lag(close, 3) OVER s) AS r15,
  ln(close / lag(close, 6) OVER s) AS r30, sum(coalesce(vwap, close) * volume) OVER s AS cum_pv,
  sum(volume) OVER s AS cum_v, lag(volume, 1) OVER s AS prev_volume, row_number() OVER s AS n_bars,
  quantile_cont(volume, 0.5) OVER (s ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS med12,
  ln(lead(close, 3) OVER s / lead(open, 1) OVER s) AS fwd_ret_15m
FROM fx_rth WINDOW s AS (PARTITION BY ticker, d ORDER BY m)"""


@view("session_gaps", "fx_rth")
def _gaps():
    return """SELECT ticker, d, ln(first_open / lag(last_close) OVER (PARTITION BY ticker ORDER BY d)) AS overnight_gap
FROM (SELECT ticker, d, min_by(open, m) AS first_open, max_by(close, m) AS last_close FROM fx_rth GROUP BY ticker, d)"""


@view("bar_features", "bar_moves", "session_gaps")
def _bar_features():
    return """SELECT b.ticker, b.d, b.m, b.r5, b.r15, b.r30,
  CASE WHEN count(b.r5) OVER w6 = 6 THEN stddev_samp(b.r5) OVER w6 END AS rv30,
  CASE WHEN count(b.r5) OVER w12 = 12 THEN stddev_samp(b.r5) OVER w12 END AS rv60,
  (b.high - b.low) / b.close AS range_frac, (b.close - b.low) / (b.high - b.low + 1e-12) AS close_pos,
  ln(b.close / (b.cum_pv / (b.cum_v + 1e-12))) AS vwap_dist,
  CASE WHEN b.n_bars >= 12 THEN b.volume / nullif(b.med12, 0) END AS vol_ratio,
  b.volume / nullif(b.prev_volume, 0) AS vol_accel,
  CAST(b.m - b.open_min AS DOUBLE) AS minutes_since_open, CAST(b.close_min - b.m AS DOUBLE) AS minutes_to_close,
  g.overnight_gap, y.r15 AS spy_r15, y.r30 AS spy_r30, CAST(NULL AS DOUBLE) AS qqq_r15, CAST(NULL AS DOUBLE) AS qqq_r30,
  b.fwd_ret_15m
FROM bar_moves b JOIN session_gaps g ON g.ticker = b.ticker AND g.d = b.d
LEFT JOIN bar_moves y ON y.ticker = 'SPY' AND y.d = b.d AND y.m = b.m
WINDOW w6 AS (PARTITION BY b.ticker, b.d ORDER BY b.m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
  w12 AS (PARTITION BY b.ticker, b.d ORDER BY b.m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""


def bar_query(name: str, step, *columns: str):
    @query(name, "bar_features", sql=f"SELECT {KEY}, {q6s(*columns)} FROM bar_features")
    def _(fx):
        return step(fx.rth).select("ticker", day(), "minute", *rounded(*columns))


bar_query("bar_returns", bar_ops.returns, "r5", "r15", "r30")
bar_query("realized_vol", lambda b: bar_ops.realized_vol(bar_ops.returns(b)), "rv30", "rv60")
bar_query("bar_geometry", bar_ops.bar_geometry, "range_frac", "close_pos")
bar_query("vwap_distance", bar_ops.vwap_distance, "vwap_dist")
bar_query("volume_shape", bar_ops.volume_shape, "vol_ratio", "vol_accel")
bar_query("session_clock", bar_ops.session_clock, "minutes_since_open", "minutes_to_close")
bar_query("forward_return", bar_ops.forward_return, "fwd_ret_15m")
bar_query("market_context_intraday", lambda b: bar_ops.with_market_context(b, b), "spy_r15", "spy_r30", "qqq_r15", "qqq_r30")
bar_query("price_features", bar_ops.build_price_features, *bar_ops.PRICE_FEATURES, "fwd_ret_15m")


@query("overnight_gap", "session_gaps", sql=f"SELECT {DAY_KEY}, {q6s('overnight_gap')} FROM session_gaps")
def _(fx):
    return bar_ops.overnight_gaps(fx.rth).select("ticker", day(), *rounded("overnight_gap"))


# ---- pre-market snapshot ------------------------------------------------------------------------------------


@view("pm_days", "fx_bars", "fx_cal", "fx_rth")
def _pm_days():
    return """SELECT r.*, p.pm_first_open, p.pm_last_close, p.pm_high, p.pm_low, p.pm_dollar, coalesce(p.n_pm, 0) AS n_pm
FROM (SELECT ticker, d, max_by(close, m) AS rth_last_close, max(high) AS rth_high, min(low) AS rth_low,
        sum(coalesce(vwap, close) * volume) AS rth_dollar FROM fx_rth GROUP BY ticker, d) r
LEFT JOIN (SELECT b.ticker, b.d, min_by(open, m) AS pm_first_open, max_by(close, m) AS pm_last_close,
        max(high) AS pm_high, min(low) AS pm_low, sum(coalesce(vwap, close) * volume) AS pm_dollar, count(*) AS n_pm
      FROM fx_bars b JOIN fx_cal c ON c.d = b.d WHERE m >= 240 AND m <= 530 GROUP BY b.ticker, b.d) p
  ON p.ticker = r.ticker AND p.d = r.d"""


@view("pm_trailing", "pm_days")
def _pm_trailing():
    return """SELECT *, lag(rth_last_close) OVER t AS prev_close, lag(day_ret) OVER t AS prev_day_ret,
  lag(ln(rth_high / rth_low)) OVER t AS prev_day_range,
  CASE WHEN count(day_ret) OVER w5 >= 3 THEN stddev_samp(day_ret) OVER w5 END AS vol5,
  CASE WHEN count(day_ret) OVER w20 >= 10 THEN stddev_samp(day_ret) OVER w20 END AS vol20,
  lag(rth_dollar) OVER t / nullif(CASE WHEN count(rth_dollar) OVER w21 >= 10
    THEN quantile_cont(rth_dollar, 0.5) OVER w21 END, 0) AS prev_rth_vol_ratio,
  CASE WHEN count(pm_dollar) OVER w20 >= 10 THEN quantile_cont(pm_dollar, 0.5) OVER w20 END AS pm_median
FROM (SELECT *, ln(rth_last_close / lag(rth_last_close) OVER (PARTITION BY ticker ORDER BY d)) AS day_ret FROM pm_days)
WINDOW t AS (PARTITION BY ticker ORDER BY d),
  w5 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w20 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
  w21 AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING)"""


@view("snapshots", "pm_trailing")
def _snapshots():
    return """SELECT s.*, y.gap AS spy_gap, y.pm_ret AS spy_pm_ret, s.gap - y.gap AS rel_gap FROM
 (SELECT ticker, d, ln(pm_last_close / prev_close) AS gap, ln(pm_last_close / prev_close) / (vol20 + 1e-12) AS gap_norm,
    ln(pm_last_close / pm_first_open) AS pm_ret, ln(pm_high / pm_low) AS pm_range, pm_dollar AS pm_dollar_vol,
    pm_dollar / nullif(pm_median, 0) AS pm_vol_ratio, CAST(n_pm AS DOUBLE) AS n_pm_bars, vol5, vol20, prev_day_ret,
    prev_day_range, prev_rth_vol_ratio FROM pm_trailing) s
LEFT JOIN (SELECT d, ln(pm_last_close / prev_close) AS gap, ln(pm_last_close / pm_first_open) AS pm_ret
           FROM pm_trailing WHERE ticker = 'SPY') y ON y.d = s.d"""


def session_days(fx):
    return pm_ops.session_days(fx.bars, fx.calendar)


RTH_DAY = ("rth_last_close", "rth_high", "rth_low", "rth_dollar")
PM_DAY = ("pm_first_open", "pm_last_close", "pm_high", "pm_low", "pm_dollar")
TRAILING = ("prev_close", "prev_day_ret", "prev_day_range", "vol5", "vol20", "prev_rth_vol_ratio")


@query("rth_daily", "pm_days", sql=f"SELECT {DAY_KEY}, {q6s(*RTH_DAY)} FROM pm_days")
def _(fx):
    return pm_ops.rth_daily(session_days(fx)).select("ticker", day(), *rounded(*RTH_DAY))


@query("premarket_daily", "pm_days", sql=f"SELECT {DAY_KEY}, {q6s(*PM_DAY)}, n_pm FROM pm_days")
def _(fx):
    return pm_ops.premarket_daily(session_days(fx)).select("ticker", day(), *rounded(*PM_DAY), "n_pm")


@query("trailing_measures", "pm_trailing", sql=f"SELECT {DAY_KEY}, {q6s(*TRAILING)} FROM pm_trailing")
def _(fx):
    return pm_ops.trailing_measures(session_days(fx)).select("ticker", day(), *rounded(*TRAILING))


@query("market_context_daily", "snapshots", sql=f"SELECT {DAY_KEY}, {q6s('gap', 'spy_gap', 'spy_pm_ret', 'rel_gap')} FROM snapshots")
def _(fx):
    rows = pm_ops.premarket_measures(pm_ops.trailing_measures(session_days(fx)))
    joined = pm_ops.with_daily_context(rows, rows.filter(F.col("ticker") == "SPY"))
    return joined.select("ticker", day(), *rounded("gap", "spy_gap", "spy_pm_ret", "rel_gap"))


@query("snapshot_features", "snapshots", sql=f"SELECT {DAY_KEY}, {q6s(*pm_ops.SNAPSHOT_FEATURES)} FROM snapshots")
def _(fx):
    built = pm_ops.build_snapshot_features(fx.bars, fx.calendar)
    return built.select("ticker", day(), *rounded(*pm_ops.SNAPSHOT_FEATURES))


# ---- daily series ---------------------------------------------------------------------------------------------


@view("targets", "fx_daily")
def _targets():
    return """SELECT *, lead(close) OVER t AS tomorrow, CAST(coalesce(lead(close) OVER t > close, false) AS INT) AS target
FROM fx_daily WINDOW t AS (PARTITION BY ticker ORDER BY d)"""


@view("trends", "targets")
def _trends():
    parts = []
    for h in (2, 5, 60, 250, 1000):
        parts.append(
            f"CASE WHEN count(close) OVER a{h} = {h} THEN close / avg(close) OVER a{h} END AS close_ratio_{h}, "
            f"CASE WHEN count(target) OVER b{h} = {h} THEN CAST(sum(target) OVER b{h} AS DOUBLE) END AS trend_{h}"
        )
    frames = ", ".join(
        f"a{h} AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW), "
        f"b{h} AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING)"
        for h in (2, 5, 60, 250, 1000)
    )
    return f"SELECT ticker, d, {', '.join(parts)} FROM targets WINDOW {frames}"


@query("next_day_target", "targets", sql=f"SELECT {DAY_KEY}, {q6s('tomorrow')}, target FROM targets")
def _(fx):
    return next_day_target(fx.daily).select("ticker", day(), *rounded("tomorrow"), "target")


@query("trend_features", "trends", sql=f"SELECT {DAY_KEY}, {q6s(*trend_columns())} FROM trends")
def _(fx):
    return trend_features(next_day_target(fx.daily)).select("ticker", day(), *rounded(*trend_columns()))


@query(
    "feature_label_join",
    "snapshots",
    "labelled",
    sql="SELECT s.ticker, CAST(s.d AS VARCHAR) AS date, "
    + q6("s.gap")
    + " AS gap, l.label FROM snapshots s JOIN labelled l ON l.ticker = s.ticker AND l.d = s.d",
)
def _(fx):
    from .labels import fixture_labels

    snaps = pm_ops.build_snapshot_features(fx.bars, fx.calendar)
    joined = snaps.join(fixture_labels(fx).labels.select("ticker", "date", "label"), ["ticker", "date"])
    return joined.select("ticker", day(), r6("gap").alias("gap"), "label")
