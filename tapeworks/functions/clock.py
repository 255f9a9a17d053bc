"""Exchange-clock columns: instants are stored in UTC, sessions are reasoned about in exchange time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import BAR_MINUTES, EXCHANGE_TZ, WINDOW_MINUTES

MICROS_PER_MINUTE = 60_000_000


def local_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, EXCHANGE_TZ)


def minute_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).cast("int")


def with_et(df: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Add the exchange ``date``, the ``minute`` of day and the 15-minute ``slot`` of an UTC instant."""
    local = local_time(F.col(ts))
    minute = minute_of_day(local)
    return df.withColumns(
        {
            "date": F.to_date(local),
            "minute": minute,
            "slot": (minute - minute % WINDOW_MINUTES).cast("int"),
        }
    )


def exchange_instant(date: Column, minute: Column) -> Column:
    """UTC instant of a minute of day on an exchange date (daylight saving handled by the zone rules)."""
    wall = F.timestamp_add("MINUTE", minute, date.cast("timestamp"))
    return F.to_utc_timestamp(wall, EXCHANGE_TZ)


def shift_minutes(ts: Column, minutes: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(minutes * MICROS_PER_MINUTE))


def in_killzone(start: int, end: int, minute: str = "minute") -> Column:
    """Minute of day within the trading window, both ends included."""
    return F.col(minute).between(start, end)


def premarket_usable(cutoff: int, start: int, latency_seconds: int, minute: str = "minute") -> Column:
    """A pre-market bar counts only if it has arrived (end plus latency) by the cutoff minute."""
    arrives = (F.col(minute) + BAR_MINUTES) * 60 + latency_seconds
    return (F.col(minute) >= start) & (arrives <= cutoff * 60)
