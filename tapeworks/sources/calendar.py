"""The exchange calendar as a small local dimension table, computed from its rules.

Its size depends on the requested years only (about 252 rows a year), so it is built on the driver and enters plans
as a local relation: Catalyst knows its exact size, folds its derived columns and broadcasts it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import CLOSE_MINUTE, CUTOFF_MINUTE, EARLY_CLOSE_MINUTE, LABEL_DELAY_MINUTES, OPEN_MINUTE
from ..functions.clock import exchange_instant, shift_minutes
from ..runtime import bounded_broadcast

# One-off closures that no rule gives (national days of mourning).
EXTRA_CLOSURES = frozenset({dt.date(2018, 12, 5), dt.date(2025, 1, 9)})
MON, THU, FRI, SAT = 0, 3, 4, 5
ONE_DAY = dt.timedelta(days=1)


def easter_sunday(year: int) -> dt.date:
    """Gregorian Easter by the Gauss-Lichtenberg rule (public algorithm), as a day counted from 1 March."""
    century = year // 100
    leap_shift = (3 * century + 3) // 4
    moon_shift = 15 + leap_shift - (8 * century + 13) // 25
    cycle = year % 19
    seed = (19 * cycle + moon_shift) % 30
    limit = 21 + seed - (seed + cycle // 11) // 29
    first_sunday = 7 - (year + year // 4 + 2 - leap_shift) % 7
    march_day = limit + 7 - (limit - first_sunday) % 7
    return dt.date(year, 3, 1) + dt.timedelta(days=march_day - 1)


def _nth_weekday(year: int, month: int, weekday: int, nth: int) -> dt.date:
    first = dt.date(year, month, 1)
    return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (nth - 1))


def _observed(day: dt.date) -> dt.date:
    """A Saturday holiday is kept on the Friday before, a Sunday one on the Monday after."""
    return day + {SAT: -ONE_DAY, SAT + 1: ONE_DAY}.get(day.weekday(), dt.timedelta())


@lru_cache(maxsize=None)
def holidays(year: int) -> frozenset[dt.date]:
    """Full-day closures under the rules in force since 2015."""
    may_end = dt.date(year, 5, 31)
    days = {
        _nth_weekday(year, 1, MON, 3),
        _nth_weekday(year, 2, MON, 3),
        easter_sunday(year) - 2 * ONE_DAY,
        may_end - dt.timedelta(days=may_end.weekday()),
        _observed(dt.date(year, 7, 4)),
        _nth_weekday(year, 9, MON, 1),
        _nth_weekday(year, 11, THU, 4),
        _observed(dt.date(year, 12, 25)),
    }
    if dt.date(year, 1, 1).weekday() != SAT:  # a Saturday New Year is not moved into the old year
        days.add(_observed(dt.date(year, 1, 1)))
    if year >= 2022:
        days.add(_observed(dt.date(year, 6, 19)))
    return frozenset(days) | EXTRA_CLOSURES


def closes_early(day: dt.date) -> bool:
    """Half days: the eve of Independence Day and of Christmas, and the day after Thanksgiving."""
    eve = (day.month, day.day) in ((7, 3), (12, 24)) and day.weekday() < FRI
    return eve or day == _nth_weekday(day.year, 11, THU, 4) + ONE_DAY


def session_calendar(
    spark: SparkSession,
    start: str | dt.date = "2015-01-01",
    end: str | dt.date = "2030-12-31",
    close_overrides: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per session in [start, end]: date, session_idx, open/close minute and instants, cutoff, label time.

    ``close_overrides`` maps a date to another closing minute.
    """
    first, last = dt.date.fromisoformat(str(start)), dt.date.fromisoformat(str(end))
    every_day = (first + dt.timedelta(days=i) for i in range((last - first).days + 1))
    days = [d for d in every_day if d.weekday() < SAT and d not in holidays(d.year)]
    overrides = {dt.date.fromisoformat(k): v for k, v in (close_overrides or {}).items()}
    closes = [overrides.get(d, EARLY_CLOSE_MINUTE if closes_early(d) else CLOSE_MINUTE) for d in days]
    small = pa.table(
        {
            "date": pa.array(days, pa.date32()),
            "session_idx": pa.array(range(len(days)), pa.int32()),
            "open_min": pa.array([OPEN_MINUTE] * len(days), pa.int32()),
            "close_min": pa.array(closes, pa.int32()),
        }
    )
    date, close_ts = F.col("date"), exchange_instant(F.col("date"), F.col("close_min"))
    return spark.createDataFrame(small).withColumns(
        {
            "open_ts": exchange_instant(date, F.col("open_min")),
            "close_ts": close_ts,
            "cutoff_ts": exchange_instant(date, F.lit(CUTOFF_MINUTE)),
            "label_ts": shift_minutes(close_ts, LABEL_DELAY_MINUTES),
        }
    )


# Calendar joins assume at most this many sessions (a century of trading days).
SESSION_BOUND = 26_000


def small_calendar(calendar: DataFrame, *columns: str) -> DataFrame:
    """The calendar columns a join needs, hinted for broadcast under the session bound."""
    return bounded_broadcast(calendar.select("date", *columns), SESSION_BOUND)


def sessions_between(calendar: DataFrame, start, end) -> DataFrame:
    return calendar.filter(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


def is_session(df: DataFrame, calendar: DataFrame, name: str = "is_session") -> DataFrame:
    """Flag whether each row's date is a trading session."""
    days = small_calendar(calendar).withColumn(name, F.lit(True))
    return df.join(days, "date", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def next_session(df: DataFrame, calendar: DataFrame, name: str = "next_session") -> DataFrame:
    """First session strictly after each row's date, however far ahead; NULL past the calendar's end."""
    known = calendar.select("date", F.col("date").alias("session"))
    asked = df.select("date", F.lit(None).cast("date").alias("session")).distinct()
    # One row per distinct date, so the ordered window holds days, not rows.
    days = known.union(asked).filter(F.col("date").isNotNull()).groupBy("date").agg(F.max("session").alias("session"))
    # Latest first, so the next session is a running value.
    later = Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(days.select("date", F.last("session", ignorenulls=True).over(later).alias(name)), "date", "left")


def premarket_cutoff(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Attach the 09:00 cutoff instant; a date that is no session is an error when the column is read."""
    joined = df.join(small_calendar(calendar, "cutoff_ts"), "date", "left")
    problem = F.raise_error(F.concat(F.col("date").cast("string"), F.lit(" is not a trading session")))
    return joined.withColumn("cutoff_ts", F.coalesce(F.col("cutoff_ts"), problem.cast("timestamp")))
