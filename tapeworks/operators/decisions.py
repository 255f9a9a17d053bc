"""Forecasts to decisions: edge, risk, trend and optional gates as one projected expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import HOLD, LONG, SHORT, CostModel, DecisionConfig, RiskConfig
from ..functions.scalars import holds


def entry_gates(config: DecisionConfig) -> Column:
    """Conditions shared by both directions; an optional gate applies only when active, and unknown fails it."""
    gate = holds(F.col("minutes_to_close") >= config.min_minutes_to_close)
    if config.min_news_articles_2h > 0:
        gate = gate & holds(F.col("news_articles_2h") >= config.min_news_articles_2h)
    if config.max_minutes_since_open > 0:
        gate = gate & holds(F.col("minutes_since_open") <= config.max_minutes_since_open)
    return gate


def decide(rows: DataFrame, costs: CostModel = CostModel(), config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Add ``decision`` (long / short / hold) from q10, q50, q90, r30 and the gates; short wins if both pass."""
    hurdle = costs.round_trip_cost + config.min_edge_bps / 1e4
    max_risk, oppose = config.max_risk_bps / 1e4, config.trend_oppose_bps / 1e4
    gates = entry_gates(config)
    if config.min_p_win > 0:
        long_edge, short_edge = F.col("p_long_win") >= config.min_p_win, F.col("p_short_win") >= config.min_p_win
    else:
        long_edge, short_edge = F.col("q50") >= hurdle, F.col("q50") <= -hurdle
    long = holds(long_edge & (F.col("q10") >= -max_risk) & (F.col("r30") > -oppose)) & gates
    short = holds(short_edge & (F.col("q90") <= max_risk) & (F.col("r30") < oppose)) & gates
    if config.align_news_sentiment:
        long = long & holds(F.col("news_sent_signed_2h") > 0)
        short = short & holds(F.col("news_sent_signed_2h") < 0)
    return rows.withColumn("decision", F.when(short, SHORT).when(long, LONG).otherwise(HOLD))


def size_position(q10: Column, config: RiskConfig = RiskConfig()) -> Column:
    """Position as a fraction of equity: fixed risk over the forecast downside, capped per name."""
    downside = F.greatest(F.abs(q10), F.lit(config.q10_floor))
    sized = F.least(config.risk_per_trade / downside, F.lit(config.max_name_fraction))
    return F.when(q10.isNotNull(), sized)


def select_candidates(scores: DataFrame, min_score: float = 0.0, max_candidates: int | None = 5) -> DataFrame:
    """Per date: score floor, then the best ``max_candidates`` (None keeps all); ties go to the lower ticker."""
    passing = scores.filter(F.col("score") >= min_score)
    if max_candidates is None:
        return passing
    order = Window.partitionBy("date").orderBy(F.desc("score"), "ticker")
    return passing.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_candidates).drop("nth")
