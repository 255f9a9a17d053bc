"""Exact medians of large groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rolling import running

ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY


def grouped_median(rows: DataFrame, value: str, *keys: str, name: str = "median") -> DataFrame:
    """Exact median of ``value`` per key.

    A mergeable sketch first brackets the median within its guaranteed rank error. Values below the bracket are only
    counted; those inside it, about a two-thousandth of the group, collapse to distinct values with counts, and the
    middle ranks are read off a running count in a window that streams them in order.
    """
    known = rows.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    bracket = known.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(F.lit(0.5 - MARGIN), F.lit(0.5 + MARGIN)), ACCURACY).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
    )
    placed = known.join(bracket, list(keys))
    # Everything below the bracket shares one cell per key; inside it every distinct value has its own.
    cell = F.when(F.col("_v") >= F.col("_b")[0], F.col("_v"))
    cells = placed.filter(F.col("_v") <= F.col("_b")[1]).groupBy(*keys, "_n", cell.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(running(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())))

    def at_rank(rank):
        """The first value whose running count exceeds the zero-based rank."""
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))

    middle = F.col("_n") - 1
    found = at_rank(F.floor(middle / 2)) + at_rank(F.ceil(middle / 2))
    return cells.withColumn("_upto", upto).groupBy(*keys).agg((found / 2).alias(name))
