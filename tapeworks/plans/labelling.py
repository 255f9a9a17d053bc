"""From bars to session labels: one fit range and one label range, or all walk-forward folds at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import LabelConfig, WalkForwardConfig
from ..operators.folds import TEST, TRAIN, tag_folds, walk_forward_folds
from ..operators.labels import classify_sessions, label_stability, qualify_windows
from ..operators.tod import SLOT, tod_rank
from ..operators.windows import build_windows


@dataclass(frozen=True)
class Labelled:
    windows: DataFrame
    qualified: DataFrame
    labels: DataFrame


def label_range(
    bars: DataFrame, calendar: DataFrame, fit: tuple, span: tuple, config: LabelConfig = LabelConfig()
) -> Labelled:
    """Label the sessions of ``span`` with statistics fitted on ``fit``; the two ranges must not touch.

    Windows of both ranges come from one pass and stay one table: a flag tells reference rows from labelled ones.
    """
    if str(fit[1]) >= str(span[0]):
        raise ValueError("the fit range must end before the labelled range starts")

    def within(span: tuple):
        return F.col("date").between(*[F.lit(str(d)).cast("date") for d in span])

    windows = build_windows(bars, calendar, fit[0], span[1])
    flagged = windows.filter(within(fit) | within(span)).withColumn("is_train", within(fit))
    ranked = tod_rank(flagged, config.min_obs, config.eps).filter(~F.col("is_train"))
    qualified = qualify_windows(ranked, config)
    return Labelled(flagged, qualified, classify_sessions(qualified, config))


def label_folds(windows: DataFrame, folds: DataFrame, config: LabelConfig = LabelConfig()) -> Labelled:
    """Label every segment of every fold against that fold's training windows, in one job keyed by fold_id.

    Windows are hashed by (ticker, slot) before the folds multiply them, so the per-fold ranks need no shuffle of the copies;
    the fold table holds a row per day and segment, a calendar's size.
    """
    placed = windows.repartition("ticker", "slot")
    tagged = tag_folds(placed, F.broadcast(folds)).withColumn("is_train", F.col("segment") == TRAIN)
    ranked = tod_rank(tagged, config.min_obs, config.eps, "fold_id")
    qualified = qualify_windows(ranked, config)
    return Labelled(tagged, qualified, classify_sessions(qualified, config, "fold_id", "segment"))


def walk_forward_labels(
    windows: DataFrame, days: DataFrame, layout: WalkForwardConfig, config: LabelConfig = LabelConfig()
) -> DataFrame:
    """Label stability over test segments, one row per fold."""
    folds = walk_forward_folds(days, layout)
    done = label_folds(windows, folds, config)
    test = F.col("segment") == TEST
    trusted = done.qualified.filter("trusted_slot").select("fold_id", *SLOT).distinct()
    return label_stability(done.qualified.filter(test), done.labels.filter(test), trusted)
