"""Tumbling 15-minute session windows over five-minute bars, empty windows included."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import BAR_MINUTES, WINDOW_MINUTES
from ..functions.rolling import SESSION
from ..functions.scalars import log_ratio, price_ref
from ..sources.calendar import sessions_between, small_calendar
from .asof import by_session, session_bars_asof

BARS_PER_WINDOW = WINDOW_MINUTES // BAR_MINUTES


def session_windows(session_bars: DataFrame, grid: DataFrame) -> DataFrame:
    """Aggregate regular-session bars to windows for every (ticker, date) of ``grid``.

    ``grid`` carries open_min and close_min per session. Its empty windows are added as zero-weight rows before
    one grouped aggregate, so no join is needed and a window without bars still appears (r_w unknown, rest 0).
    """
    in_window = F.col("minute") - F.col("open_min")
    slot = (F.col("minute") - in_window % WINDOW_MINUTES).cast("int")
    rows = by_session(session_bars).select(
        *SESSION,
        slot.alias("slot"),
        "open_min",
        "minute",
        "open",
        "close",
        "volume",
        (price_ref() * F.col("volume")).alias("dollars"),
        "trade_count",
        F.lit(1).alias("bar"),
    )
    starts = F.sequence(F.col("open_min"), F.col("close_min") - WINDOW_MINUTES, F.lit(WINDOW_MINUTES))
    empty = by_session(grid).select(*SESSION, "open_min", F.explode(starts).alias("slot"))
    none = F.lit(None)
    padded = empty.select(
        *SESSION,
        "slot",
        "open_min",
        none.cast("int").alias("minute"),
        *[none.cast("double").alias(c) for c in ("open", "close", "volume", "dollars")],
        none.cast("bigint").alias("trade_count"),
        F.lit(0).alias("bar"),
    )
    real = F.col("bar") == 1
    first_open = F.min_by("open", F.when(real, F.col("minute")))
    last_close = F.max_by("close", F.when(real, F.col("minute")))
    windows = rows.unionByName(padded).groupBy(*SESSION, "slot", "open_min")
    # A group without a padded row belongs to a session that the grid does not list.
    measured = windows.agg(
        F.abs(log_ratio(last_close, first_open)).alias("r_w"),
        F.coalesce(F.sum("dollars"), F.lit(0.0)).alias("dollar_vol"),
        F.coalesce(F.sum("trade_count"), F.lit(0)).alias("trade_count"),
        (F.count_if(F.col("volume") > 0) / BARS_PER_WINDOW).alias("active_subbar_fraction"),
        F.sum("bar").alias("n_subbars"),
        F.count_if(F.col("bar") == 0).alias("listed"),
    )
    return measured.filter(F.col("listed") > 0).drop("listed")


def full_grid(tickers: DataFrame, calendar: DataFrame, start, end) -> DataFrame:
    """Every ticker on every session in [start, end]: dates are generated per ticker, then met with the
    calendar on an equi-join, so no cross join is planned."""
    dates = F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
    hours = small_calendar(sessions_between(calendar, start, end), "open_min", "close_min")
    return tickers.select("ticker").distinct().select("ticker", F.explode(dates).alias("date")).join(hours, "date")


def stored_grid(session_bars: DataFrame) -> DataFrame:
    """Only the (ticker, date) pairs that have regular-session bars."""
    return session_bars.select(*SESSION, "open_min", "close_min").distinct()


def build_windows(bars: DataFrame, calendar: DataFrame, start, end, universe: DataFrame | None = None) -> DataFrame:
    """Windows of every ticker and session in the range, each session read as of half an hour after its close.

    ``universe`` lists the tickers, and only those appear; without it they are the tickers that have bars in the range
    (one extra scan of the ticker column there).
    """
    low, high = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    ranged = bars.filter(F.col("date").between(low, high))
    grid = full_grid(ranged if universe is None else universe, calendar, start, end)
    return session_windows(session_bars_asof(ranged, calendar), grid)
