"""Decisions to non-overlapping trades, and trade summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import BAR_MINUTES, HOLD, HORIZON_BARS, LONG, SHORT, CostModel
from ..functions.rolling import SESSION
from ..functions.scalars import share
from .intraday import TARGET
from .quantile import grouped_median

SUMMARY = (
    "n_trades", "n_long", "n_short", "trades_per_day", "hold_fraction", "hit_rate", "avg_net_bps", "median_net_bps",
    "total_net_return", "avg_gross_bps",
)


def thin_events(decided: DataFrame, costs: CostModel = CostModel(), *keys: str) -> DataFrame:
    """One position per ticker at a time: in bar order, keep a signal only 15 minutes after the last kept one.

    Holds and rows without a forward return drop out first; what remains of a session (at most 78 rows) folds in one
    JVM aggregate expression. Output rows follow the trade schema.
    """
    wait = BAR_MINUTES * HORIZON_BARS
    signals = decided.filter((F.col("decision") != HOLD) & F.col(TARGET).isNotNull())
    q10 = F.col("q10") if "q10" in decided.columns else F.lit(None).cast("double")
    item = F.struct("minute", F.col("decision").alias("direction"), F.col(TARGET).alias("fwd"), q10.alias("q10"))
    grouped = signals.groupBy(*keys, *SESSION).agg(F.sort_array(F.collect_list(item)).alias("items"))
    element = "struct<minute:int,direction:string,fwd:double,q10:double>"
    start = F.struct(
        F.lit(-wait).alias("last"), F.array().cast(f"array<{element}>").alias("kept")
    )

    def keep(state: Column, x: Column) -> Column:
        free = x["minute"] >= state["last"] + wait
        return F.struct(
            F.when(free, x["minute"]).otherwise(state["last"]).alias("last"),
            F.when(free, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"),
        )

    kept = grouped.select(*keys, *SESSION, F.inline(F.aggregate("items", start, keep, lambda s: s["kept"])))
    gross = F.when(F.col("direction") == LONG, F.col("fwd")).otherwise(-F.col("fwd"))
    return kept.select(
        *keys,
        *SESSION,
        "minute",
        "direction",
        gross.alias("gross_ret"),
        (gross - costs.round_trip_cost).alias("net_ret"),
        "q10",
    )


def trade_summary(trades: DataFrame, universe: DataFrame, *keys: str) -> DataFrame:
    """Summary per key (at least one). ``universe`` gives n_decision_rows and n_days per key, so a key without trades still reports.

    All measures combine map-side; the exact median brackets its group first (see ``grouped_median``).
    """
    net = F.col("net_ret")
    trades = trades.select(*keys, "direction", "net_ret", "gross_ret")
    stats = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(F.col("direction") == LONG).alias("n_long"),
        F.count_if(F.col("direction") == SHORT).alias("n_short"),
        share(net > 0).alias("hit_rate"),
        (F.avg(net) * 1e4).alias("avg_net_bps"),
        F.sum(net).alias("total_net_return"),
        (F.avg("gross_ret") * 1e4).alias("avg_gross_bps"),
    )
    middle = grouped_median(trades, "net_ret", *keys, name="median_net").withColumn(
        "median_net_bps", F.col("median_net") * 1e4
    )
    joined = universe.join(stats, list(keys), "left").join(middle, list(keys), "left")
    n = F.coalesce("n_trades", F.lit(0))
    some = n > 0
    return joined.select(
        *keys,
        n.alias("n_trades"),
        F.coalesce("n_long", F.lit(0)).alias("n_long"),
        F.coalesce("n_short", F.lit(0)).alias("n_short"),
        (n / F.greatest("n_days", F.lit(1))).alias("trades_per_day"),
        F.when(some, 1.0 - n / F.greatest("n_decision_rows", F.lit(1))).otherwise(1.0).alias("hold_fraction"),
        *[F.when(some, F.col(c)).alias(c) for c in ("hit_rate", "avg_net_bps", "median_net_bps")],
        F.coalesce("total_net_return", F.lit(0.0)).alias("total_net_return"),
        F.when(some, F.col("avg_gross_bps")).alias("avg_gross_bps"),
    )


def decision_universe(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_decision_rows"), F.count_distinct("date").alias("n_days")
    )
