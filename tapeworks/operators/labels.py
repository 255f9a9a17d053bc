"""Window qualification and the session label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LABELS, NONE, OPENING_ONLY, SUSTAINED, LabelConfig
from ..functions.rolling import SESSION
from ..functions.scalars import holds, share


def qualify_windows(windows: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Five criteria as booleans plus their conjunction; an unknown input never qualifies."""
    cost_multiple = F.col("r_w") / config.round_trip_cost
    executable = config.assumed_spread_bps <= config.s_max_bps and config.est_impact_bps <= config.i_max_bps
    checks = {
        "ok_move": F.col("z_move") >= config.k_move,
        "ok_cost": cost_multiple >= config.m_cost,
        "ok_liquidity": (F.col("dollar_vol_pctile") >= config.p_vol) & (F.col("trades_pctile") >= config.p_trades),
        "ok_execution": F.lit(executable),
        "ok_real": (F.col("trade_count") >= config.n_min_trades)
        & (F.col("active_subbar_fraction") >= config.f_min_active),
    }
    checked = windows.withColumns({"cost_multiple": cost_multiple, **{k: holds(c) for k, c in checks.items()}})
    everything = F.col("ok_move")
    for name in list(checks)[1:]:
        everything = everything & F.col(name)
    return checked.withColumn("qualifies", everything)


def session_label(n_qualifying: Column, n_late: Column, min_late: int) -> Column:
    return (
        F.when(n_qualifying == 0, NONE).when(n_late >= min_late, SUSTAINED).otherwise(OPENING_ONLY)
    )


def classify_sessions(qualified: DataFrame, config: LabelConfig = LabelConfig(), *keys: str) -> DataFrame:
    """One labelled row per (keys, ticker, date): none, opening_only or sustained."""
    late = F.col("slot") >= F.col("open_min") + config.opening_minutes
    counts = qualified.groupBy(*keys, *SESSION).agg(
        F.count_if("qualifies").alias("n_qualifying"),
        F.count_if(F.col("qualifies") & late).alias("n_late"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    return counts.select(
        *keys,
        *SESSION,
        session_label(F.col("n_qualifying"), F.col("n_late"), config.min_late_windows).alias("label"),
        "n_qualifying",
        (F.col("n_qualifying") - F.col("n_late")).alias("n_opening"),
        "n_late",
        "n_windows",
    )


def label_distribution(labels: DataFrame) -> DataFrame:
    """Sessions per ticker and label, zero-filled."""
    counted = labels.groupBy("ticker").pivot("label", list(LABELS)).count().na.fill(0)
    return counted.select("ticker", *LABELS)


def label_shares(labels: DataFrame) -> DataFrame:
    """Count and share of each label over all sessions; one aggregate row is unpivoted, no global window."""
    totals = labels.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == name).alias(name) for name in LABELS]
    )
    return totals.unpivot(["n"], list(LABELS), "label", "n_sessions").select(
        "label", "n_sessions", F.try_divide("n_sessions", "n").alias("share")
    )


def qualifying_rate(qualified: DataFrame) -> DataFrame:
    return qualified.agg(F.count(F.lit(1)).alias("n_windows"), share(F.col("qualifies")).alias("qualify_rate"))


def label_stability(qualified: DataFrame, labels: DataFrame, trusted: DataFrame) -> DataFrame:
    """Per fold: labelled sessions, trusted slots, class fractions and the qualifying-window rate."""
    fractions = [share(F.col("label") == name).alias(f"frac_{name}") for name in LABELS]
    sessions = labels.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_sessions"), *fractions)
    rates = qualified.groupBy("fold_id").agg(share(F.col("qualifies")).alias("qualify_rate"))
    slots = trusted.groupBy("fold_id").agg(F.count(F.lit(1)).alias("trusted_slots"))
    return (
        sessions.join(rates, "fold_id")
        .join(slots, "fold_id", "left")
        .withColumn("trusted_slots", F.coalesce("trusted_slots", F.lit(0)))
    )
