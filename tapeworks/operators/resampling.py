"""Confidence intervals that resample whole trading days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

MOST = 12  # copies of a day; a Poisson weight of mean 1 is larger once in ten billion draws


def poisson_steps() -> list[int]:
    """Draws of 32 bits from which on a Poisson weight of mean 1 is at least 1, 2, ..."""
    total, steps = 0.0, []
    for k in range(MOST):
        total += math.exp(-1) / math.factorial(k)
        steps.append(int(total * 2**32))
    return steps


def day_weight(replicate: str, date: str, seed: int) -> Column:
    """How often a replicate draws a day: a Poisson number of mean 1 from a hash, the same on every run and in every task."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(replicate).cast("string"), F.col(date).cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return sum(((draw >= step).cast("int") for step in poisson_steps()), F.lit(0))


def bootstrap_means(rows: DataFrame, value: str, keys: tuple[str, ...], replicates: int = 1000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """Per key: n_days, n_rows, mean, and the interval low to high that holds ``level`` of the resampled means.

    Days are resampled, not rows, as rows of one day depend on each other; a day's weight in a replicate is the same for all
    keys. Rows fold to one sum for each (key, day) before they are weighted, so none is copied. Null values drop out. A
    replicate that draws no day of a key is left out.
    """
    days = rows.filter(F.col(value).isNotNull()).groupBy(*keys, "date").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.sum("n").alias("n_rows"), (F.sum("s") / F.sum("n")).alias("mean"))
    drawn = days.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", day_weight("replicate", "date", seed))
    means = drawn.filter("w > 0").groupBy(*keys, "replicate").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    tail = (1 - level) / 2
    ends = means.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    return whole.join(ends, list(keys)).select(*keys, "n_days", "n_rows", "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
