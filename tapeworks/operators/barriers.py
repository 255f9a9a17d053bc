"""Barrier exits: the first bar whose range spans a stop or a target, else the last close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import holds


def spans(price: str) -> Column:
    """The bar traded through a price. A bar that gaps past it without spanning it does not count."""
    return holds((F.col("low") <= F.col(price)) & (F.col(price) <= F.col("high")))


def first_touch(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Exit of each armed position from its forward bars (one group per key): exit, exit_reason, exit_minute.

    ``rows`` repeats the position's stop and target on each forward bar. The stop wins when a bar spans both.
    """
    hit = F.when(spans("stop"), F.struct("minute", F.lit("stop").alias("reason"), F.col("stop").alias("px"))).when(
        spans("target"), F.struct("minute", F.lit("target").alias("reason"), F.col("target").alias("px"))
    )
    end = F.max(F.struct("minute", F.col("close").alias("px")))
    done = rows.groupBy(*keys).agg(F.min(hit).alias("hit"), end.alias("end"))
    touched = F.col("hit").isNotNull()
    return done.select(
        *keys,
        F.when(touched, F.col("hit.px")).otherwise(F.col("end.px")).alias("exit"),
        F.when(touched, F.col("hit.reason")).otherwise(F.lit("time")).alias("exit_reason"),
        F.when(touched, F.col("hit.minute")).otherwise(F.col("end.minute")).alias("exit_minute"),
    )


def limit_then_touch(setups: DataFrame, bars: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Limit order after the signal: filled by the first later bar that spans the entry, then barrier exits from the
    fill bar on; positions still open leave at the day's last close. Unfilled orders give no row.

    ``keys`` name the setup columns to keep; they include ticker and date, on which both sides share a partitioning.
    """
    later = setups.select(*keys).join(
        bars.select("ticker", "date", "minute", "high", "low", "close"), ["ticker", "date"]
    ).filter(F.col("minute") > F.col("signal_minute"))
    order = Window.partitionBy(*[k for k in keys if k in ("setting", "ticker", "date")])
    fill = F.min(F.when(spans("entry"), F.col("minute"))).over(order)
    filled = later.withColumn("fill_minute", fill).filter(F.col("minute") >= F.col("fill_minute"))
    return first_touch(filled, (*keys, "fill_minute"))
