"""Time-of-day reference statistics per (ticker, slot), fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import ratio

SLOT = ("ticker", "slot")


def tod_stats_fit(train: DataFrame, min_obs: int = 60, *keys: str) -> DataFrame:
    """Median and inter-quartile range of the movement, with the observation count, for trusted slots."""
    quartiles = F.percentile("r_w", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = train.filter(F.col("r_w").isNotNull()).groupBy(*keys, *SLOT).agg(
        quartiles.alias("q"), F.count(F.lit(1)).alias("n_obs")
    )
    return stats.filter(F.col("n_obs") >= min_obs).select(
        *keys, *SLOT, F.col("q")[1].alias("median_rw"), (F.col("q")[2] - F.col("q")[0]).alias("iqr_rw"), "n_obs"
    )


def tod_rank(rows: DataFrame, min_obs: int = 60, eps: float = 1e-6, *keys: str) -> DataFrame:
    """Score rows flagged by ``is_train`` (true: reference rows) against their slot's training distribution.

    All statistics are window aggregates over one hash partitioning on (keys, ticker, slot): the movement's
    median/IQR over the whole partition, and the empirical percentile as a running count of training rows up to
    and including each value (equal values are peers, hence "share of training values <= x").
    A partition holds one row per session, so it is bounded by the calendar.
    """
    known = F.col("is_train") & F.col("r_w").isNotNull()
    part = Window.partitionBy(*keys, *SLOT)
    train_move = F.when(known, F.col("r_w"))
    quartiles = F.percentile(train_move, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(part)
    n_obs = F.count(train_move).over(part)

    def pctile(value: str):
        upto = part.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return ratio(F.count(train_move).over(upto), n_obs)

    scored = rows.withColumns(
        {"_q": quartiles, "_n": n_obs, "_dv": pctile("dollar_vol"), "_tc": pctile("trade_count")}
    )
    trusted = (F.col("_n") >= min_obs) & F.col("r_w").isNotNull()
    q = F.col("_q")
    return scored.withColumns(
        {
            "z_move": F.when(trusted, (F.col("r_w") - q[1]) / (q[2] - q[0] + eps)),
            "dollar_vol_pctile": F.when(trusted, F.col("_dv")),
            "trades_pctile": F.when(trusted, F.col("_tc")),
            "trusted_slot": F.col("_n") >= min_obs,
        }
    ).drop("_q", "_n", "_dv", "_tc")


def tod_transform(train: DataFrame, rows: DataFrame, min_obs: int = 60, eps: float = 1e-6) -> DataFrame:
    """Add z_move, dollar_vol_pctile and trades_pctile to ``rows`` from the ``train`` windows."""
    both = train.withColumn("is_train", F.lit(True)).unionByName(rows.withColumn("is_train", F.lit(False)))
    return tod_rank(both, min_obs, eps).filter(~F.col("is_train")).drop("is_train")
