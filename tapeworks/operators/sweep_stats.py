"""Statistics of a sweep strategy per setting and ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rolling import running
from ..functions.scalars import share

KEYS = ("setting", "ticker")


def with_drawdown(trades: DataFrame, start_equity: float = 10_000.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Drawdown of each equity point from the running peak, the starting equity included."""
    upto = running(Window.partitionBy(*keys).orderBy("date"))
    peak = F.greatest(F.max("equity").over(upto), F.lit(start_equity))
    return trades.withColumn("drawdown", F.col("equity") / peak - 1)


def strategy_stats(trades: DataFrame, start_equity: float = 10_000.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Counts, R statistics, profit factor (infinite without losses), return, drawdown and exit reasons."""
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    zero = F.lit(0.0)
    gross_loss = F.coalesce(-F.sum(F.when(loss, F.col("pnl"))), zero)
    gross_win = F.coalesce(F.sum(F.when(win, F.col("pnl"))), zero)
    total = F.sum("pnl")
    reasons = {"target_hits": "target", "stop_hits": "stop", "time_exits": "time"}
    return with_drawdown(trades, start_equity, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(win).alias("wins"),
        F.count_if(loss).alias("losses"),
        share(win).alias("win_rate"),
        F.coalesce(F.avg(F.when(win, F.col("r_multiple"))), zero).alias("avg_win_r"),
        F.coalesce(F.avg(F.when(loss, F.col("r_multiple"))), zero).alias("avg_loss_r"),
        F.avg("r_multiple").alias("expectancy_r"),
        F.when(gross_loss > 0, F.try_divide(gross_win, gross_loss))
        .otherwise(F.lit(float("inf")))
        .alias("profit_factor"),
        total.alias("total_pnl"),
        (total / start_equity * 100).alias("total_return_pct"),
        (total + start_equity).alias("end_equity"),
        (F.least(F.min("drawdown"), zero) * 100).alias("max_drawdown_pct"),
        share(F.col("used_fvg")).alias("fvg_share"),
        *[F.count_if(F.col("exit_reason") == reason).alias(name) for name, reason in reasons.items()],
    )


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Last close over first close in percent, per ticker."""
    moment = F.struct("date", "minute")
    first, last = F.min_by("close", moment), F.max_by("close", moment)
    return bars.groupBy("ticker").agg(((F.try_divide(last, first) - 1) * 100).alias("return_pct"))


def best_setting(stats: DataFrame) -> DataFrame:
    """Per ticker, the setting with the highest expectancy (settings without trades never appear)."""
    return stats.groupBy("ticker").agg(
        F.max_by("setting", F.struct("expectancy_r", "setting")).alias("setting"),
        F.max("expectancy_r").alias("expectancy_r"),
    )
