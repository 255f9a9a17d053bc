"""Windows, time-of-day statistics, qualification, session labels and their stability over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeworks.config import LABELS
from tapeworks.operators.folds import fold_bounds, holdout_days, tag_folds, walk_forward_folds
from tapeworks.operators.labels import label_distribution, label_shares, qualifying_rate
from tapeworks.operators.tod import tod_stats_fit, tod_transform
from tapeworks.operators.windows import build_windows, session_windows, stored_grid
from tapeworks.plans.labelling import label_folds, label_range, walk_forward_labels
from tapeworks.sources.calendar import sessions_between

from .fixtures import FIRST_DAY, FIT, LABEL, LAST_DAY, LAYOUT, SPAN, Fixture
from .registry import day, q6, q6s, query, r6, rounded, view

COST = LABEL.round_trip_cost
WINDOW_OUT = (
    "ticker, CAST(d AS VARCHAR) AS date, CAST(slot AS INT) AS slot, "
    + q6s("r_w", "dollar_vol", "active_subbar_fraction")
    + ", trade_count, n_subbars"
)


def window_columns() -> list:
    return [
        "ticker",
        day(),
        "slot",
        *rounded("r_w", "dollar_vol", "active_subbar_fraction"),
        "trade_count",
        F.col("n_subbars").cast("bigint").alias("n_subbars"),
    ]


def all_windows(fx: Fixture) -> DataFrame:
    return build_windows(fx.bars, fx.calendar, FIRST_DAY, LAST_DAY)


@query("build_windows", "fx_windows", sql=f"SELECT {WINDOW_OUT} FROM fx_windows")
def _(fx):
    return all_windows(fx).select(*window_columns())


@query(
    "session_windows",
    "fx_windows",
    "fx_rth",
    sql=f"SELECT {WINDOW_OUT} FROM fx_windows w WHERE EXISTS (SELECT 1 FROM fx_rth b WHERE b.ticker=w.ticker AND b.d=w.d)",
)
def _(fx):
    return session_windows(fx.rth, stored_grid(fx.rth)).select(*window_columns())


@view("fit_stats", "fx_windows")
def _fit_stats():
    return f"""SELECT ticker, slot, quantile_cont(r_w, 0.5) AS median_rw,
  quantile_cont(r_w, 0.75) - quantile_cont(r_w, 0.25) AS iqr_rw, count(*) AS n_obs
FROM fx_windows WHERE r_w IS NOT NULL AND d BETWEEN DATE '{FIT[0]}' AND DATE '{FIT[1]}'
GROUP BY ticker, slot HAVING count(*) >= {LABEL.min_obs}"""


@query(
    "tod_stats_fit",
    "fit_stats",
    sql=f"SELECT ticker, CAST(slot AS INT) AS slot, {q6s('median_rw', 'iqr_rw')}, n_obs FROM fit_stats",
)
def _(fx):
    fitted = tod_stats_fit(build_windows(fx.bars, fx.calendar, *FIT), LABEL.min_obs)
    return fitted.select("ticker", "slot", *rounded("median_rw", "iqr_rw"), "n_obs")


@view("ranked", "fit_stats", "fx_windows")
def _ranked():
    return f"""SELECT w.ticker, w.d, w.slot, w.open_min, w.r_w, w.dollar_vol, w.trade_count, w.active_subbar_fraction,
  CASE WHEN w.r_w IS NOT NULL THEN (w.r_w - s.median_rw) / (s.iqr_rw + {LABEL.eps}) END AS z_move,
  CASE WHEN w.r_w IS NOT NULL AND s.n_obs IS NOT NULL THEN
    (SELECT count(*) FROM fx_windows t WHERE t.ticker = w.ticker AND t.slot = w.slot AND t.r_w IS NOT NULL
       AND t.d BETWEEN DATE '{FIT[0]}' AND DATE '{FIT[1]}' AND t.dollar_vol <= w.dollar_vol) / s.n_obs END AS dollar_vol_pctile,
  CASE WHEN w.r_w IS NOT NULL AND s.n_obs IS NOT NULL THEN
    (SELECT count(*) FROM fx_windows t WHERE t.ticker = w.ticker AND t.slot = w.slot AND t.r_w IS NOT NULL
       AND t.d BETWEEN DATE '{FIT[0]}' AND DATE '{FIT[1]}' AND t.trade_count <= w.trade_count) / s.n_obs END AS trades_pctile
FROM fx_windows w LEFT JOIN fit_stats s ON s.ticker = w.ticker AND s.slot = w.slot
WHERE w.d BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}'"""


@query(
    "tod_transform",
    "ranked",
    sql="SELECT ticker, CAST(d AS VARCHAR) AS date, CAST(slot AS INT) AS slot, "
    + q6s("z_move", "dollar_vol_pctile", "trades_pctile")
    + " FROM ranked",
)
def _(fx):
    train, rows = (build_windows(fx.bars, fx.calendar, *span) for span in (FIT, SPAN))
    ranked = tod_transform(train, rows, LABEL.min_obs, LABEL.eps)
    return ranked.select("ticker", day(), "slot", *rounded("z_move", "dollar_vol_pctile", "trades_pctile"))


def qualify_sql(source: str, keys: str = "") -> str:
    return f"""SELECT *, ok_move AND ok_cost AND ok_liquidity AND ok_execution AND ok_real AS qualifies FROM (
SELECT {keys} ticker, d, slot, open_min, r_w / {COST} AS cost_multiple,
  coalesce(z_move >= {LABEL.k_move}, false) AS ok_move,
  coalesce(r_w / {COST} >= {LABEL.m_cost}, false) AS ok_cost,
  coalesce(dollar_vol_pctile >= {LABEL.p_vol} AND trades_pctile >= {LABEL.p_trades}, false) AS ok_liquidity,
  {LABEL.assumed_spread_bps} <= {LABEL.s_max_bps} AND {LABEL.est_impact_bps} <= {LABEL.i_max_bps} AS ok_execution,
  coalesce(trade_count >= {LABEL.n_min_trades} AND active_subbar_fraction >= {LABEL.f_min_active}, false) AS ok_real
FROM {source})"""


def classify_sql(source: str, keys: str = "") -> str:
    return f"""SELECT *, n_qualifying - n_late AS n_opening,
  CASE WHEN n_qualifying = 0 THEN 'none' WHEN n_late >= {LABEL.min_late_windows} THEN 'sustained'
       ELSE 'opening_only' END AS label
FROM (SELECT {keys} ticker, d, count(CASE WHEN qualifies THEN 1 END) AS n_qualifying,
        count(CASE WHEN qualifies AND slot >= open_min + {LABEL.opening_minutes} THEN 1 END) AS n_late,
        count(*) AS n_windows FROM {source} GROUP BY {keys} ticker, d)"""


@view("qualified", "ranked")
def _qualified():
    return qualify_sql("ranked")


@view("labelled", "qualified")
def _labelled():
    return classify_sql("qualified")


def fixture_labels(fx: Fixture):
    return label_range(fx.bars, fx.calendar, FIT, SPAN, LABEL)


@query(
    "qualify_windows",
    "qualified",
    sql="SELECT ticker, CAST(d AS VARCHAR) AS date, CAST(slot AS INT) AS slot, "
    + q6s("cost_multiple")
    + ", ok_move, ok_cost, ok_liquidity, ok_execution, ok_real, qualifies FROM qualified",
)
def _(fx):
    flags = ["ok_move", "ok_cost", "ok_liquidity", "ok_execution", "ok_real", "qualifies"]
    return fixture_labels(fx).qualified.select("ticker", day(), "slot", *rounded("cost_multiple"), *flags)


@query(
    "classify_sessions",
    "labelled",
    sql="SELECT ticker, CAST(d AS VARCHAR) AS date, label, n_qualifying, n_opening, n_late, n_windows FROM labelled",
)
def _(fx):
    counts = ["n_qualifying", "n_opening", "n_late", "n_windows"]
    return fixture_labels(fx).labels.select("ticker", day(), "label", *counts)


@query(
    "label_distribution",
    "labelled",
    sql="SELECT ticker, "
    + ", ".join(f"count(CASE WHEN label = '{x}' THEN 1 END) AS {x}" for x in LABELS)
    + " FROM labelled GROUP BY ticker",
)
def _(fx):
    return label_distribution(fixture_labels(fx).labels)


@query(
    "label_shares",
    "labelled",
    sql="SELECT c.label, count(l.label) AS n_sessions, "
    + q6("count(l.label) / (SELECT count(*) FROM labelled)")
    + " AS share FROM (SELECT unnest(['none', 'opening_only', 'sustained']) AS label) c"
    " LEFT JOIN labelled l ON l.label = c.label GROUP BY c.label",
)
def _(fx):
    return label_shares(fixture_labels(fx).labels).select("label", "n_sessions", *rounded("share"))


@query(
    "qualifying_rate",
    "qualified",
    sql="SELECT count(*) AS n_windows, "
    + q6("avg(CASE WHEN qualifies THEN 1.0 ELSE 0.0 END)")
    + " AS qualify_rate FROM qualified",
)
def _(fx):
    return qualifying_rate(fixture_labels(fx).qualified).select("n_windows", *rounded("qualify_rate"))


# ---- folds over the sessions that have data -------------------------------------------------------------------


@view("stored_days", "fx_rth")
def _stored_days():
    return "SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INT) AS i FROM (SELECT DISTINCT d FROM fx_rth)"


@view("fold_ids", "stored_days")
def _fold_ids():
    last = LAYOUT.test_offset + LAYOUT.test_sessions
    return f"""SELECT CAST(k AS INT) AS fold_id FROM (SELECT unnest(generate_series(0, 200)) AS k)
WHERE k * {LAYOUT.step_sessions} + {last} <= (SELECT count(*) FROM stored_days) - {LAYOUT.holdout_sessions}"""


@view("folds", "fold_ids")
def _folds():
    step = LAYOUT.step_sessions
    spans = [
        ("train", 0, LAYOUT.train_sessions),
        ("calibrate", LAYOUT.calibrate_offset, LAYOUT.calibrate_sessions),
        ("test", LAYOUT.test_offset, LAYOUT.test_sessions),
    ]
    return "\nUNION ALL ".join(
        f"SELECT fold_id, '{name}' AS segment, d FROM fold_ids, stored_days"
        f" WHERE i >= fold_id*{step} + {start} AND i < fold_id*{step} + {start + size}"
        for name, start, size in spans
    )


def fixture_days(fx: Fixture) -> DataFrame:
    return fx.rth.select("date").distinct()


def fixture_folds(fx: Fixture) -> DataFrame:
    return walk_forward_folds(fixture_days(fx), LAYOUT)


@query("walk_forward_folds", "folds", sql="SELECT fold_id, segment, CAST(d AS VARCHAR) AS date FROM folds")
def _(fx):
    return fixture_folds(fx).select("fold_id", "segment", day())


@query(
    "holdout_days",
    "stored_days",
    sql=f"SELECT CAST(d AS VARCHAR) AS date FROM stored_days ORDER BY d DESC LIMIT {LAYOUT.holdout_sessions}",
)
def _(fx):
    return holdout_days(fixture_days(fx), LAYOUT).select(day())


@query(
    "fold_bounds",
    "folds",
    sql="SELECT fold_id, "
    + ", ".join(
        f"CAST({fn}(CASE WHEN segment = '{s}' THEN d END) AS VARCHAR) AS {s}_{end}"
        for s in ("train", "calibrate", "test")
        for fn, end in (("min", "from"), ("max", "to"))
    )
    + " FROM folds GROUP BY fold_id",
)
def _(fx):
    bounds = fold_bounds(fixture_folds(fx))
    return bounds.select("fold_id", *[day(c) for c in bounds.columns[1:]])


@query(
    "fold_membership",
    "folds",
    "fx_rth",
    sql="SELECT f.fold_id, f.segment, b.ticker, count(*) AS n_bars FROM fx_rth b JOIN folds f ON f.d = b.d GROUP BY ALL",
)
def _(fx):
    tagged = tag_folds(fx.rth, fixture_folds(fx))
    return tagged.groupBy("fold_id", "segment", "ticker").agg(F.count(F.lit(1)).alias("n_bars"))


@view("stored_windows", "fx_windows", "fx_rth")
def _stored_windows():
    return "SELECT w.* FROM fx_windows w WHERE EXISTS (SELECT 1 FROM fx_rth b WHERE b.ticker = w.ticker AND b.d = w.d)"


@view("fold_windows", "stored_windows", "folds")
def _fold_windows():
    return "SELECT f.fold_id, f.segment, w.* FROM stored_windows w JOIN folds f ON f.d = w.d"


@view("fold_stats", "fold_windows")
def _fold_stats():
    return f"""SELECT fold_id, ticker, slot, quantile_cont(r_w, 0.5) AS median_rw,
  quantile_cont(r_w, 0.75) - quantile_cont(r_w, 0.25) AS iqr_rw, count(*) AS n_obs
FROM fold_windows WHERE r_w IS NOT NULL AND segment = 'train'
GROUP BY fold_id, ticker, slot HAVING count(*) >= {LABEL.min_obs}"""


@view("fold_ranked", "fold_stats", "fold_windows")
def _fold_ranked():
    def rank(value: str) -> str:
        return f"""(SELECT count(*) FROM fold_windows t WHERE t.fold_id = w.fold_id AND t.ticker = w.ticker
    AND t.slot = w.slot AND t.segment = 'train' AND t.r_w IS NOT NULL AND t.{value} <= w.{value}) / s.n_obs"""

    return f"""SELECT w.fold_id, w.segment, w.ticker, w.d, w.slot, w.open_min, w.r_w, w.trade_count,
  w.active_subbar_fraction,
  CASE WHEN w.r_w IS NOT NULL THEN (w.r_w - s.median_rw) / (s.iqr_rw + {LABEL.eps}) END AS z_move,
  CASE WHEN w.r_w IS NOT NULL AND s.n_obs IS NOT NULL THEN {rank("dollar_vol")} END AS dollar_vol_pctile,
  CASE WHEN w.r_w IS NOT NULL AND s.n_obs IS NOT NULL THEN {rank("trade_count")} END AS trades_pctile
FROM fold_windows w LEFT JOIN fold_stats s ON s.fold_id = w.fold_id AND s.ticker = w.ticker AND s.slot = w.slot"""


@view("fold_qualified", "fold_ranked")
def _fold_qualified():
    return qualify_sql("fold_ranked", "fold_id, segment,")


@view("fold_labels", "fold_qualified")
def _fold_labels():
    return classify_sql("fold_qualified", "fold_id, segment,")


def stored_windows(fx: Fixture) -> DataFrame:
    return session_windows(fx.rth, stored_grid(fx.rth))


@query(
    "fold_labels",
    "fold_labels",
    sql="SELECT fold_id, segment, ticker, CAST(d AS VARCHAR) AS date, label, n_qualifying, n_late FROM fold_labels",
)
def _(fx):
    labels = label_folds(stored_windows(fx), fixture_folds(fx), LABEL).labels
    return labels.select("fold_id", "segment", "ticker", day(), "label", "n_qualifying", "n_late")


@view("stability", "fold_labels", "fold_qualified", "fold_stats")
def _stability():
    fractions = ", ".join(f"avg(CASE WHEN label = '{x}' THEN 1.0 ELSE 0.0 END) AS frac_{x}" for x in LABELS)
    return f"""SELECT l.*, q.qualify_rate, coalesce(s.trusted_slots, 0) AS trusted_slots FROM
 (SELECT fold_id, count(*) AS n_sessions, {fractions} FROM fold_labels WHERE segment = 'test' GROUP BY fold_id) l
 JOIN (SELECT fold_id, avg(CASE WHEN qualifies THEN 1.0 ELSE 0.0 END) AS qualify_rate
       FROM fold_qualified WHERE segment = 'test' GROUP BY fold_id) q ON q.fold_id = l.fold_id
 LEFT JOIN (SELECT fold_id, count(*) AS trusted_slots FROM fold_stats GROUP BY fold_id) s ON s.fold_id = l.fold_id"""


STABILITY = tuple(f"frac_{x}" for x in LABELS) + ("qualify_rate",)


def fixture_stability(fx: Fixture) -> DataFrame:
    return walk_forward_labels(stored_windows(fx), fixture_days(fx), LAYOUT, LABEL)


@query(
    "label_stability",
    "stability",
    sql=f"SELECT fold_id, n_sessions, {q6s(*STABILITY)}, trusted_slots FROM stability",
)
def _(fx):
    return fixture_stability(fx).select("fold_id", "n_sessions", *rounded(*STABILITY), "trusted_slots")
