"""As-of reads: what was known at a given moment, and coverage of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import local_time, shift_minutes
from ..functions.rolling import SESSION
from ..sources.calendar import small_calendar

BAR_KEYS = ("ticker", "date", "minute", "event_ts")
BAR_VALUES = ("open", "high", "low", "close", "volume", "trade_count", "vwap")


def by_session(df: DataFrame) -> DataFrame:
    """Hash rows by (ticker, date) once; every later session-level aggregate, window and dedup reuses it."""
    return df.repartition(*SESSION)


def latest_revision(bars: DataFrame, *carried: str) -> DataFrame:
    """Keep the last-arrived version of each bar.

    Primitive ``max_by`` buffers keep this a hash aggregate with map-side combine, so a heavily revised bar
    shrinks before the shuffle. ``carried`` columns depend on the bar's date and join the grouping key.
    """
    latest = [F.max_by(c, "available_ts").alias(c) for c in BAR_VALUES if c in bars.columns]
    return bars.groupBy(*BAR_KEYS, *carried).agg(*latest, F.max("available_ts").alias("available_ts"))


def bars_asof(bars: DataFrame, as_of, lookback_minutes: int | None = None, *carried: str) -> DataFrame:
    """Bars visible at ``as_of`` (a literal, or a column such as a session's label time), latest revision each.

    A bar is not available before it starts, so its exchange date is not after that of ``as_of``: the implied bounds on
    ``date`` prune the partitions of a stored table.
    """
    moment = _moment(as_of)
    visible = bars.filter((F.col("available_ts") <= moment) & (F.col("date") <= F.to_date(local_time(moment))))
    if lookback_minutes is not None:
        earliest = shift_minutes(moment, -lookback_minutes)
        visible = visible.filter((F.col("event_ts") >= earliest) & (F.col("date") >= F.to_date(local_time(earliest))))
    return latest_revision(visible, *carried)


def latest_bars(bars: DataFrame) -> DataFrame:
    """Every stored bar at its newest revision."""
    return latest_revision(bars)


def news_asof(articles: DataFrame, tags: DataFrame, as_of) -> DataFrame:
    """Tagged articles visible at ``as_of`` with the sentiment given for each ticker (NULL when none).

    Articles are available after publishing; a stored table, which carries the publishing date, is pruned by it.
    """
    moment = _moment(as_of)
    visible = articles.filter(F.col("available_ts") <= moment)
    if "date" in articles.columns:
        visible = visible.filter(F.col("date") <= F.to_date(local_time(moment)))
    return visible.join(tags, "article_id")


def _moment(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def rth_bars(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars inside the regular session by the calendar (open <= start < close); adds open_min and close_min."""
    hours = small_calendar(calendar, "open_min", "close_min")
    return bars.join(hours, "date").filter(
        (F.col("minute") >= F.col("open_min")) & (F.col("minute") < F.col("close_min"))
    )


def session_bars_asof(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Regular-session bars as known half an hour after their own close, one version each."""
    hours = small_calendar(calendar, "open_min", "close_min", "label_ts")
    timed = bars.join(hours, "date").filter(
        (F.col("minute") >= F.col("open_min"))
        & (F.col("minute") < F.col("close_min"))
        & (F.col("available_ts") <= F.col("label_ts"))
    )
    return latest_revision(by_session(timed), "open_min", "close_min")


def range_bars_asof(
    bars: DataFrame, calendar: DataFrame, start, end, regular_only: bool = True, before_open_minutes: int = 360
) -> DataFrame:
    """Bars of the sessions in [start, end] as known after the last close of the range.

    ``regular_only=False`` also keeps extended hours, from ``before_open_minutes`` ahead of the first open.
    The session range is pushed to the scan as a date filter.
    """
    low, high = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    wanted = calendar.filter(F.col("date").between(low, high))
    # The bounds are scalar subqueries: no job runs before the plan does, and without a session they are NULL and no row passes.
    visible = bars.filter(F.col("date").between(low, high) & (F.col("available_ts") <= wanted.agg(F.max("label_ts")).scalar()))
    if regular_only:
        return latest_revision(by_session(rth_bars(visible, wanted)), "open_min", "close_min")
    earliest = wanted.agg(shift_minutes(F.min("open_ts"), -before_open_minutes)).scalar()
    return latest_revision(by_session(visible.filter(F.col("event_ts") >= earliest)))


def daily_bars(bars: DataFrame) -> DataFrame:
    """Exchange-day OHLCV over all hours."""
    return bars.groupBy(*SESSION).agg(
        F.min_by("open", "minute").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "minute").alias("close"),
        F.sum("volume").alias("volume"),
    )


def bar_coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts")
    )


def news_coverage(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.min("published_ts").alias("first_ts"),
        F.max("published_ts").alias("last_ts"),
    )


def distinct_sessions(bars: DataFrame) -> DataFrame:
    return bars.select(*SESSION).distinct()


def stored_session_index(sessions: DataFrame) -> DataFrame:
    """Dense position of each stored session within its ticker (one row per trading day)."""
    return sessions.withColumn("stored_idx", F.dense_rank().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def with_prior_sessions(bars: DataFrame, days: DataFrame, lookback: int = 1) -> DataFrame:
    """Bars of the wanted ``days`` plus each ticker's ``lookback`` stored sessions before them.

    Works on session rows (one per ticker-day): a session is kept when one of its next ``lookback`` stored
    sessions is wanted, which a forward window answers without a self-join.
    """
    ahead = Window.partitionBy("ticker").orderBy("date").rowsBetween(0, lookback)
    wanted = small_calendar(days.select("date").distinct().withColumn("wanted", F.lit(True)), "wanted")
    flagged = distinct_sessions(bars).join(wanted, "date", "left")
    kept = flagged.withColumn("keep", F.max(F.coalesce("wanted", F.lit(False))).over(ahead)).filter("keep")
    return bars.join(kept.select(*SESSION), list(SESSION), "left_semi")
