"""Intraday trip monitor: threshold crossings with hysteresis, a cooldown for each ticker, and a limit for each interval."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rolling import session_order
from ..runtime import materialize


def crossings(rows: DataFrame, value: str, enter: float, leave: float) -> DataFrame:
    """The bars on which a session's monitor switches on: ``value`` reaches ``enter`` after start or after it fell below ``leave``.

    Between the two levels, and where the value is unknown, the monitor stays as it is.
    """
    switch = F.when(F.col(value) >= enter, 1).when(F.col(value) < leave, 0)
    state = F.last(switch, ignorenulls=True).over(session_order().rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_on", F.coalesce(state, F.lit(0)))
    was = F.coalesce(F.lag("_on", 1).over(session_order()), F.lit(0))
    return marked.withColumn("_was", was).filter("_on = 1 AND _was = 0").drop("_on", "_was")


def cooled_down(events: DataFrame, keys: tuple[str, ...], time: str, wait: int) -> DataFrame:
    """Of each key's events the first, and then always the next one at least ``wait`` after the last one kept.

    Greedy choice is a walk along links: each event points to the first one at least ``wait`` later. Links are found by one running
    value over events and their ends of cooldown, latest first. The walk is taken by pointer doubling: in each round the marked
    events also mark those their pointers reach, and pointers are joined with themselves, so a key with n kept events
    takes about log2(n) rounds of joins by (key, time), and no loop over a group. Of events of one key and time one counts.
    """
    events = materialize(events.dropDuplicates([*keys, time]))
    points = events.select(*keys, F.col(time).cast("long").alias("_t"))
    ends = points.select(*keys, (F.col("_t") + wait).alias("_at"), F.lit(None).cast("long").alias("_event"), F.col("_t").alias("_of"), F.lit(1).alias("_side"))
    both = points.select(*keys, F.col("_t").alias("_at"), F.col("_t").alias("_event"), F.lit(None).cast("long").alias("_of"), F.lit(0).alias("_side")).unionByName(ends)
    later = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    links = both.withColumn("_next", F.last("_event", ignorenulls=True).over(later)).filter("_of IS NOT NULL AND _next IS NOT NULL")
    links = materialize(links.select(*keys, F.col("_of").alias("_t"), "_next"))
    longest = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    marked = points.groupBy(*keys).agg(F.min("_t").alias("_t"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        reached = marked.join(links, [*keys, "_t"]).select(*keys, F.col("_next").alias("_t"))
        marked = materialize(marked.unionByName(reached))
        onward = links.select(*keys, F.col("_t").alias("_next"), F.col("_next").alias("_beyond"))
        links = materialize(links.join(onward, [*keys, "_next"]).select(*keys, "_t", F.col("_beyond").alias("_next")))
    kept = marked.withColumnRenamed("_t", time)
    return events.withColumn(time, F.col(time).cast("long")).join(kept, [*keys, time], "left_semi")


def strongest(events: DataFrame, time: str, interval: int, strength: str, most: int) -> DataFrame:
    """At most ``most`` events of each interval of time, the strongest first, ties by ticker and time."""
    order = Window.partitionBy("_interval").orderBy(F.desc(strength), "ticker", time)
    ranked = events.withColumn("_interval", F.floor(F.col(time) / interval)).withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= most).drop("_interval", "_rank")
