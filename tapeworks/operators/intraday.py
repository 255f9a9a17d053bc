"""Features of each completed five-minute bar, and the 15-minute forward return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import HORIZON_BARS
from ..functions.rolling import SESSION, day_order, rolling_median, rolling_std, running, session_order
from ..functions.scalars import log_ratio, price_ref, ratio
from ..runtime import bounded_broadcast
from ..sources.calendar import SESSION_BOUND
from .asof import by_session

EPS = 1e-12
# Output column names.
PRICE_FEATURES = (
    "r5", "r15", "r30", "rv30", "rv60", "range_frac", "close_pos", "vwap_dist", "vol_ratio", "vol_accel",
    "minutes_since_open", "minutes_to_close", "overnight_gap", "spy_r15", "spy_r30", "qqq_r15", "qqq_r30",
)
TARGET = "fwd_ret_15m"
CONTEXT = {"SPY": "spy", "QQQ": "qqq"}
REGULAR_BARS = 78


def returns(bars: DataFrame) -> DataFrame:
    """Log returns over 1, 3 and 6 stored bars of the session."""
    order = session_order()
    return bars.withColumns(
        {name: log_ratio("close", F.lag("close", n).over(order)) for name, n in (("r5", 1), ("r15", 3), ("r30", 6))}
    )


def realized_vol(bars: DataFrame) -> DataFrame:
    """Sample deviation of r5 over the last 6 and 12 bars; NULL until the window is full."""
    order = session_order()
    return bars.withColumns(
        {
            name: rolling_std(F.col("r5"), order.rowsBetween(1 - n, 0), n)
            for name, n in (("rv30", 6), ("rv60", 12))
        }
    )


def bar_geometry(bars: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    return bars.withColumns(
        {
            "range_frac": ratio(span, "close"),
            "close_pos": (F.col("close") - F.col("low")) / (span + EPS),
        }
    )


def vwap_distance(bars: DataFrame) -> DataFrame:
    """ln(close / session VWAP so far)."""
    upto = running(session_order())
    dollars = F.sum(price_ref() * F.col("volume")).over(upto)
    vwap = dollars / (F.sum("volume").over(upto) + EPS)
    return bars.withColumn("vwap_dist", log_ratio("close", vwap))


def volume_shape(bars: DataFrame) -> DataFrame:
    """Volume against the median of the last 12 bars and against the previous bar."""
    order = session_order()
    median = rolling_median(F.col("volume"), order.rowsBetween(-11, 0), 12)
    return bars.withColumns(
        {"vol_ratio": ratio("volume", median), "vol_accel": ratio("volume", F.lag("volume", 1).over(order))}
    )


def session_clock(bars: DataFrame) -> DataFrame:
    """Minutes since the open and to the close, by the calendar columns of ``rth_bars``."""
    return bars.withColumns(
        {
            "minutes_since_open": (F.col("minute") - F.col("open_min")).cast("double"),
            "minutes_to_close": (F.col("close_min") - F.col("minute")).cast("double"),
        }
    )


def forward_return(bars: DataFrame) -> DataFrame:
    """Entry at the next bar's open, exit at the close three bars ahead; NULL where that leaves the session."""
    order = session_order()
    return bars.withColumn(
        TARGET, log_ratio(F.lead("close", HORIZON_BARS).over(order), F.lead("open", 1).over(order))
    )


def overnight_gaps(bars: DataFrame) -> DataFrame:
    """Per session: ln(first open / last close of the previous stored session).

    Only one row per ticker-day reaches the ticker-level window; the reduction happens before its shuffle.
    """
    sessions = bars.groupBy(*SESSION).agg(
        F.min_by("open", "minute").alias("first_open"), F.max_by("close", "minute").alias("last_close")
    )
    previous = F.lag("last_close", 1).over(day_order())
    return sessions.select(*SESSION, log_ratio("first_open", previous).alias("overnight_gap"))


def with_overnight_gap(bars: DataFrame) -> DataFrame:
    """The same on every bar, without a pass of its own: a ticker's history (bounded by the calendar) in the order of its sessions
    needs no other layout or sort than the frames within them."""
    history, upto = Window.partitionBy("ticker").orderBy("date", "minute"), running(session_order())
    rows = bars.withColumn("_before", F.lag("close", 1).over(history))
    return rows.withColumn("overnight_gap", log_ratio(F.first("open").over(upto), F.first("_before").over(upto))).drop("_before")


def market_context(bars: DataFrame, tickers: dict[str, str] = CONTEXT) -> DataFrame:
    """r15 and r30 of the context tickers, one row per (date, minute).

    The ticker filter sits below the windows, so it reaches the scan.
    """
    moves = returns(bars.filter(F.col("ticker").isin(*tickers)).select(*SESSION, "minute", "close"))
    cells = []
    for name, prefix in tickers.items():
        own = F.col("ticker") == name
        cells += [F.max(F.when(own, F.col(c))).alias(f"{prefix}_{c}") for c in ("r15", "r30")]
    return moves.groupBy("date", "minute").agg(*cells)


def with_market_context(rows: DataFrame, bars: DataFrame, tickers: dict[str, str] = CONTEXT) -> DataFrame:
    """Left-join the context onto every bar of every ticker; at most one row per session bar exists, which bounds
    the broadcast by the calendar (half a century of five-minute sessions stays under the limit)."""
    context = market_context(bars, tickers)
    bound = SESSION_BOUND // 2 * REGULAR_BARS
    return rows.join(bounded_broadcast(context, bound, 48), ["date", "minute"], "left")


def session_features(rth: DataFrame) -> DataFrame:
    """All within-session features and the target over one (ticker, date) partitioning and one sort."""
    return _within_sessions(by_session(rth))


def _within_sessions(rows: DataFrame) -> DataFrame:
    for step in (returns, realized_vol, bar_geometry, vwap_distance, volume_shape, session_clock, forward_return):
        rows = step(rows)
    return rows


def build_price_features(rth: DataFrame) -> DataFrame:
    """The price part of the intraday feature table: session features, overnight gap, market context.

    All but the context, which reads its few tickers alone, comes from one read of the bars, one shuffle by ticker and one sort.
    """
    return with_market_context(_within_sessions(with_overnight_gap(rth.repartition("ticker"))), rth)
