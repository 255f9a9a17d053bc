"""What a search over settings does to its best result: the deflated Sharpe ratio."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.normal import normal_cdf, normal_quantile


def return_moments(returns: DataFrame, value: str, *trial: str) -> DataFrame:
    """Per trial: n, sharpe (of one period), skew and kurtosis, from sums of powers that merge before the shuffle."""
    x = F.col(value)
    sums = returns.filter(x.isNotNull()).groupBy(*trial).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.pow(x, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)])
    raw = {k: F.col(f"s{k}") / F.col("n") for k in (1, 2, 3, 4)}
    mean = raw[1]
    second = raw[2] - mean**2
    third = raw[3] - 3 * mean * raw[2] + 2 * mean**3
    fourth = raw[4] - 4 * mean * raw[3] + 6 * mean**2 * raw[2] - 3 * mean**4
    spread = F.sqrt(F.try_divide(second * F.col("n"), F.col("n") - 1))
    some = (F.col("n") > 1) & (second > 0)
    return sums.select(
        *trial, "n", F.when(some, mean / spread).alias("sharpe"),
        F.when(some, third / F.pow(second, F.lit(1.5))).alias("skew"), F.when(some, fourth / second**2).alias("kurtosis"),
    )


def deflated_sharpe(returns: DataFrame, value: str, *trial: str) -> DataFrame:
    """Per trial: the moments, n_trials, the Sharpe ratio that the best of so many trials without skill would show, and the
    probability that the trial's own is above it, given its length, skew and tails. NULL with fewer than two trials.

    ``returns`` holds one row for each period of each trial, all trials of the search among them. The window is over one
    row for each trial.
    """
    moments = return_moments(returns, value, *trial)
    every = Window.partitionBy()
    n_trials = F.count("sharpe").over(every)
    spread = F.stddev_samp("sharpe").over(every)
    known = moments.withColumns({"n_trials": n_trials, "_spread": spread})
    chance = lambda share: normal_quantile(1 - share / F.col("n_trials"))
    best = F.col("_spread") * ((1 - np.euler_gamma) * chance(F.lit(1.0)) + np.euler_gamma * chance(F.lit(math.exp(-1))))
    luck = known.withColumn("lucky_sharpe", F.when(F.col("n_trials") > 1, best))
    error = F.sqrt(1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") ** 2)
    z = (F.col("sharpe") - F.col("lucky_sharpe")) * F.sqrt(F.col("n") - 1) / error
    return luck.withColumn("deflated", normal_cdf(z)).drop("_spread")
