"""Small hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

from tapeworks.functions.clock import exchange_instant

BAR = "ticker string, date date, minute int, open double, high double, low double, close double, volume double"
DAY, PRIOR = dt.date(2024, 3, 18), dt.date(2024, 3, 15)


def bars(spark, rows, ticker="AAA", day=DAY):
    """rows: (minute, open, high, low, close, volume)"""
    return spark.createDataFrame([(ticker, day, *r) for r in rows], BAR)


def instants(df):
    """Add event_ts, available_ts (end + 5 s), vwap, trade_count."""
    start = exchange_instant(F.col("date"), F.col("minute"))
    return df.withColumns(
        {
            "event_ts": start,
            "available_ts": F.timestamp_micros(F.unix_micros(start) + 305_000_000),
            "vwap": F.lit(None).cast("double"),
            "trade_count": F.lit(100).cast("bigint"),
        }
    )


def collected(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
