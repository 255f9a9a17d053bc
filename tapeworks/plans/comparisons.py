"""Side-by-side studies: gated against ungated breakouts, and all rows against candidate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import BreakoutConfig, CostModel, DecisionConfig, RiskConfig
from ..functions.rolling import SESSION
from ..operators.breakout import run_breakout
from ..operators.curve import Curve, realised_curve
from ..operators.decisions import decide
from ..operators.folds import TEST, tag_folds
from ..operators.metrics import forecast_metrics
from ..operators.trades import decision_universe, thin_events, trade_summary

PURE, GATED = "pure", "gated"


def arm_trades(
    rth: DataFrame, watchlist: DataFrame, folds: DataFrame, config: BreakoutConfig = BreakoutConfig(), costs: CostModel = CostModel()
) -> DataFrame:
    """Breakout trades on test days, once per arm they belong to.

    A session trades the same way in both arms, so the strategy runs once; a trade is repeated for the gated arm when
    its (fold, ticker, date) is on that fold's watchlist.
    """
    test = tag_folds(run_breakout(rth, config, costs), folds.filter(F.col("segment") == TEST)).drop("segment")
    listed = watchlist.select("fold_id", *SESSION).distinct().withColumn("listed", F.lit(True))
    joined = test.join(listed, ["fold_id", *SESSION], "left")
    arms = F.when(F.col("listed"), F.array(F.lit(PURE), F.lit(GATED))).otherwise(F.array(F.lit(PURE)))
    return joined.withColumn("arm", F.explode(arms)).drop("listed")


def arm_compare(trades: DataFrame, folds: DataFrame) -> DataFrame:
    """Trade summary per (fold, arm); both arms report every fold. A hold fraction has no meaning here."""
    test_days = folds.filter(F.col("segment") == TEST).groupBy("fold_id").agg(F.count_distinct("date").alias("n_days"))
    universe = test_days.select("fold_id", "n_days", F.explode(F.array(F.lit(PURE), F.lit(GATED))).alias("arm"))
    sized = universe.withColumn("n_decision_rows", F.lit(1))
    return trade_summary(trades, sized, "fold_id", "arm").drop("hold_fraction")


def arm_curves(trades: DataFrame, config: RiskConfig = RiskConfig()) -> Curve:
    """Realised curve of each arm's stitched test periods; an arm without trades reports its initial equity."""
    arms = trades.sparkSession.range(1).select(F.explode(F.array(F.lit(PURE), F.lit(GATED))).alias("run_id"))
    return realised_curve(trades.withColumn("run_id", F.col("arm")), config, arms)


def slice_ablation(
    rows: DataFrame,
    candidates: DataFrame,
    costs: CostModel = CostModel(),
    config: DecisionConfig = DecisionConfig(),
) -> tuple[DataFrame, DataFrame]:
    """Forecast metrics and trade summary per (fold, slice): every row counts for 'all', candidate rows also for 'cand'.

    ``rows`` carry fold_id, forecasts and features; ``candidates`` are (fold_id, ticker, date).
    """
    listed = candidates.select("fold_id", *SESSION).distinct().withColumn("listed", F.lit(True))
    tagged = rows.join(listed, ["fold_id", *SESSION], "left")
    slices = F.when(F.col("listed"), F.array(F.lit("all"), F.lit("cand"))).otherwise(F.array(F.lit("all")))
    sliced = decide(tagged, costs, config).withColumn("slice", F.explode(slices)).drop("listed")
    keys = ("fold_id", "slice")
    trades = thin_events(sliced, costs, *keys)
    return forecast_metrics(sliced, *keys), trade_summary(trades, decision_universe(sliced, *keys), *keys)
