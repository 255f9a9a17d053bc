"""The realised curve of a set of trades: sizes, exits, equity and drawdown as grouped sums and windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..config import BAR_MINUTES, HORIZON_BARS, RiskConfig
from ..functions.rolling import before, running
from .decisions import size_position


@dataclass(frozen=True)
class Curve:
    """``days``: one row per (run_id, date); ``exits``: one row per exit minute; ``summary``: one row per run_id."""

    days: DataFrame
    exits: DataFrame
    summary: DataFrame


def realised_curve(trades: DataFrame, config: RiskConfig = RiskConfig(), runs: DataFrame | None = None) -> Curve:
    """Every trade is taken at its sized share of the day's opening equity and realised at its exit.

    Days chain by the product of their growth. ``exits`` carries equity and drawdown from the earlier peak. The limits
    are reported, not enforced: the most positions open at once, the minutes at which they exceed ``max_positions``, and
    the days whose realised loss passes ``daily_loss_limit``. ``runs`` (run_id) lists runs that report even without trades.

    ``trades`` needs run_id, date, minute, net_ret, q10 and optionally entry_minute/exit_minute; a trade without a
    forecast downside cannot be sized and raises an error. Trades fold to exit minutes before the shuffle, so a run-day is
    at most a row per bar of the day, however many tickers trade.
    """
    explicit = {"entry_minute", "exit_minute"} <= set(trades.columns)
    entry = F.col("entry_minute") if explicit else F.col("minute") + BAR_MINUTES
    leave = F.col("exit_minute") if explicit else F.col("minute") + BAR_MINUTES * (HORIZON_BARS + 1)
    unknown = F.raise_error(F.lit("q10 is unknown: the trade cannot be sized")).cast("double")
    stake = F.coalesce(size_position(F.col("q10"), config), unknown) * F.col("net_ret")
    # One row for the entry and one for the exit of a trade; a position is open from its entry to before its exit.
    legs = F.array(
        F.struct(entry.cast("int").alias("at"), F.lit(1).alias("opened"), F.lit(0).alias("closed"), F.lit(0.0).alias("pnl")),
        F.struct(leave.cast("int").alias("at"), F.lit(0).alias("opened"), F.lit(1).alias("closed"), stake.alias("pnl")),
    )
    cells = trades.select("run_id", "date", F.inline(legs)).groupBy("run_id", "date", "at").agg(
        F.sum("opened").alias("opened"), F.sum("closed").alias("closed"), F.sum("pnl").alias("pnl")
    )
    day = running(Window.partitionBy("run_id", "date").orderBy("at"))
    moving = cells.withColumns(
        {"rel": 1.0 + F.sum("pnl").over(day), "open": (F.sum("opened").over(day) - F.sum("closed").over(day))}
    )
    days = moving.groupBy("run_id", "date").agg(
        F.max_by("rel", "at").alias("growth"),
        F.max(F.when(F.col("closed") > 0, F.col("rel"))).alias("high"),
        F.min("rel").alias("low"),
        F.sum("closed").alias("n_trades"),
        F.max("open").alias("peak_open"),
        F.count_if(F.col("open") > config.max_positions).alias("n_over_limit"),
    )
    order = Window.partitionBy("run_id").orderBy("date")
    initial = F.lit(config.initial_equity)
    opened = days.withColumn("start_equity", F.coalesce(initial * F.product("growth").over(before(order)), initial))
    peaked = opened.withColumns(
        {
            "end_equity": F.col("start_equity") * F.col("growth"),
            "prior_peak": F.max(F.col("start_equity") * F.col("high")).over(before(order)),
        }
    )
    exits = moving.filter(F.col("closed") > 0).join(peaked.select("run_id", "date", "start_equity", "prior_peak"), ["run_id", "date"])
    valued = exits.withColumn("equity", F.col("start_equity") * F.col("rel"))
    peak = F.greatest("prior_peak", F.max("equity").over(day))
    curve = valued.withColumn("drawdown", F.col("equity") / peak - 1).select(
        "run_id", "date", F.col("at").alias("exit_minute"), F.col("closed").alias("n_closed"), "equity", "drawdown"
    )
    lowest = curve.groupBy("run_id").agg(F.min("drawdown").alias("max_drawdown"))
    totals = peaked.groupBy("run_id").agg(
        F.max_by("end_equity", "date").alias("final_equity"),
        F.sum("n_trades").alias("n_trades"),
        F.max("peak_open").alias("peak_open"),
        F.sum("n_over_limit").alias("n_over_limit"),
        F.count_if(F.col("low") - 1 < -config.daily_loss_limit).alias("n_loss_days"),
    )
    found = totals.join(lowest, "run_id")
    if runs is not None:
        found = runs.select("run_id").distinct().join(found, "run_id", "left")
    final = F.coalesce("final_equity", initial)
    summary = found.select(
        "run_id",
        final.alias("final_equity"),
        (final / initial - 1).alias("total_return"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_trades", "peak_open", "n_over_limit", "n_loss_days")],
    )
    return Curve(peaked.drop("high", "low", "prior_peak"), curve, summary)
