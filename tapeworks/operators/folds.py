"""Chronological walk-forward folds as a (fold_id, segment, date) table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import WalkForwardConfig

TRAIN, CALIBRATE, TEST = "train", "calibrate", "test"


def ranked_days(days: DataFrame) -> DataFrame:
    """date, its position ``i`` and the number of days ``n``: the window holds distinct days, not rows."""
    distinct = days.select("date").distinct()
    return distinct.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def _tag(segment: str):
    return lambda k: F.struct(k.cast("int").alias("fold_id"), F.lit(segment).alias("segment"))


def walk_forward_folds(days: DataFrame, config: WalkForwardConfig) -> DataFrame:
    """Every (fold, segment, day) of the walk-forward layout

    ``[train][embargo][calibrate][embargo][test]``; the last ``holdout_sessions`` days belong to no fold. A day at
    position i is in a segment of fold k if ``k * step + offset <= i < k * step + offset + length``, so each day lists its
    folds by arithmetic.
    """
    step = config.step_sessions
    spare = F.col("n") - (config.holdout_sessions + config.test_offset + config.test_sessions)
    last_fold = F.when(spare >= 0, F.floor(spare / step)).otherwise(-1)
    layout = {
        TRAIN: (0, config.train_sessions),
        CALIBRATE: (config.calibrate_offset, config.calibrate_sessions),
        TEST: (config.test_offset, config.test_sessions),
    }
    parts = []
    for segment, (offset, length) in layout.items():
        lowest = F.greatest(F.lit(0), F.ceil((F.col("i") - (offset + length - 1)) / step))
        highest = last_fold if segment == TRAIN and config.expanding else F.least(last_fold, F.floor((F.col("i") - offset) / step))
        listed = F.when((highest >= lowest) & F.lit(length > 0), F.sequence(lowest, highest))
        parts.append(F.transform(listed, _tag(segment)))
    each = F.concat(*[F.coalesce(p, F.array().cast("array<struct<fold_id:int,segment:string>>")) for p in parts])
    return ranked_days(days).select("date", F.inline(each)).select("fold_id", "segment", "date")


def holdout_days(days: DataFrame, config: WalkForwardConfig) -> DataFrame:
    """The reserved last sessions."""
    return ranked_days(days).filter(F.col("i") >= F.col("n") - config.holdout_sessions).select("date")


def fold_bounds(folds: DataFrame) -> DataFrame:
    """First and last day of each segment, one row per fold."""
    spans = []
    for name in (TRAIN, CALIBRATE, TEST):
        inside = F.when(F.col("segment") == name, F.col("date"))
        spans += [F.min(inside).alias(f"{name}_from"), F.max(inside).alias(f"{name}_to")]
    return folds.groupBy("fold_id").agg(*spans)


def tag_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Repeat each row for every (fold, segment) its date belongs to: all folds run in one pass."""
    return rows.join(folds, "date")
