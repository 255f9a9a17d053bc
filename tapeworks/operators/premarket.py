"""Pre-market snapshot features: what is known about a session by its 09:00 cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import BAR_LATENCY_SECONDS, CUTOFF_MINUTE, PREMARKET_MINUTE
from ..functions.clock import premarket_usable
from ..functions.rolling import SESSION, day_order, rolling_median, rolling_std
from ..functions.scalars import log_ratio, price_ref, ratio
from ..runtime import bounded_broadcast
from ..sources.calendar import SESSION_BOUND, small_calendar

EPS = 1e-12
MARKET_TICKER = "SPY"
# Output column names.
SNAPSHOT_FEATURES = (
    "gap", "gap_norm", "pm_ret", "pm_range", "pm_dollar_vol", "pm_vol_ratio", "n_pm_bars", "vol5", "vol20",
    "prev_day_ret", "prev_day_range", "prev_rth_vol_ratio", "spy_gap", "spy_pm_ret", "rel_gap",
)


def session_days(bars: DataFrame, calendar: DataFrame, cutoff: int = CUTOFF_MINUTE) -> DataFrame:
    """Regular-session and usable pre-market summary per (ticker, date), in one pass over extended-hours bars.

    Bars fall into one part, the other, or neither by conditional aggregates, which combine map-side: a session's
    bars collapse to one row before the shuffle. Days without regular bars do not appear.
    """
    rows = bars.join(small_calendar(calendar, "open_min", "close_min"), "date")
    minute = F.col("minute")
    rth = (minute >= F.col("open_min")) & (minute < F.col("close_min"))
    pm = premarket_usable(cutoff, PREMARKET_MINUTE, BAR_LATENCY_SECONDS)
    dollars = price_ref() * F.col("volume")

    def part(mask, prefix: str) -> list:
        at = F.when(mask, minute)
        return [
            F.min_by("open", at).alias(f"{prefix}_first_open"),
            F.max_by("close", at).alias(f"{prefix}_last_close"),
            F.max(F.when(mask, F.col("high"))).alias(f"{prefix}_high"),
            F.min(F.when(mask, F.col("low"))).alias(f"{prefix}_low"),
            F.sum(F.when(mask, dollars)).alias(f"{prefix}_dollar"),
            F.count_if(mask).alias(f"n_{prefix}"),
        ]

    days = rows.groupBy(*SESSION).agg(*part(rth, "rth"), *part(pm, "pm"))
    return days.filter(F.col("n_rth") > 0).withColumns(
        {
            "rth_dollar": F.coalesce("rth_dollar", F.lit(0.0)),
            "pm_dollar": F.when(F.col("n_pm") > 0, F.coalesce("pm_dollar", F.lit(0.0))),
        }
    )


def rth_daily(days: DataFrame) -> DataFrame:
    return days.select(*SESSION, *[F.col(c) for c in ("rth_last_close", "rth_high", "rth_low", "rth_dollar")])


def premarket_daily(days: DataFrame) -> DataFrame:
    columns = ("pm_first_open", "pm_last_close", "pm_high", "pm_low", "pm_dollar", "n_pm")
    return days.select(*SESSION, *[F.col(c) for c in columns])


def trailing_measures(days: DataFrame) -> DataFrame:
    """Normalisers that end on the previous session: returns, ranges, volatility and volume ratios."""
    order = day_order()
    day_ret = days.withColumn("day_ret", log_ratio("rth_last_close", F.lag("rth_last_close", 1).over(order)))
    ret = F.col("day_ret")
    median20 = rolling_median(F.col("rth_dollar"), order.rowsBetween(-21, -2), 10)
    return day_ret.withColumns(
        {
            "prev_close": F.lag("rth_last_close", 1).over(order),
            "prev_day_ret": F.lag(ret, 1).over(order),
            "prev_day_range": F.lag(log_ratio("rth_high", "rth_low"), 1).over(order),
            "vol5": rolling_std(ret, order.rowsBetween(-5, -1), 3),
            "vol20": rolling_std(ret, order.rowsBetween(-20, -1), 10),
            "prev_rth_vol_ratio": ratio(F.lag("rth_dollar", 1).over(order), median20),
        }
    )


def premarket_measures(days: DataFrame) -> DataFrame:
    """Gap and pre-market movement against the previous close and the trailing pre-market volume."""
    order = day_order()
    gap = log_ratio("pm_last_close", "prev_close")
    median20 = rolling_median(F.col("pm_dollar"), order.rowsBetween(-20, -1), 10)
    return days.withColumns(
        {
            "gap": gap,
            "gap_norm": gap / (F.col("vol20") + EPS),
            "pm_ret": log_ratio("pm_last_close", "pm_first_open"),
            "pm_range": log_ratio("pm_high", "pm_low"),
            "pm_dollar_vol": F.col("pm_dollar"),
            "pm_vol_ratio": ratio("pm_dollar", median20),
            "n_pm_bars": F.col("n_pm").cast("double"),
        }
    )


def with_daily_context(rows: DataFrame, market: DataFrame) -> DataFrame:
    """Left-join the market ticker's gap and pre-market return by date (one row per session)."""
    context = market.select("date", F.col("gap").alias("spy_gap"), F.col("pm_ret").alias("spy_pm_ret"))
    joined = rows.join(bounded_broadcast(context, SESSION_BOUND), "date", "left")
    return joined.withColumn("rel_gap", F.col("gap") - F.col("spy_gap"))


def build_snapshot_features(
    bars: DataFrame, calendar: DataFrame, cutoff: int = CUTOFF_MINUTE, market_ticker: str = MARKET_TICKER
) -> DataFrame:
    """One row per (ticker, session) with the price features known at the cutoff."""

    # The market ticker is one of the measured rows: its day is shared over one row for each ticker-day, not read again.
    measured = premarket_measures(trailing_measures(session_days(bars, calendar, cutoff)))
    day = Window.partitionBy("date")
    of_market = lambda c: F.max(F.when(F.col("ticker") == market_ticker, F.col(c))).over(day)
    rows = measured.withColumns({"spy_gap": of_market("gap"), "spy_pm_ret": of_market("pm_ret")})
    return rows.withColumn("rel_gap", F.col("gap") - F.col("spy_gap")).select(*SESSION, *SNAPSHOT_FEATURES)
