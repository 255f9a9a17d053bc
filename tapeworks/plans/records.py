"""Experiment records: what ran, over which folds, with which metrics."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, functions as F


def plain_config(config: dict) -> str:
    """Settings as JSON; frozen dataclasses become objects."""
    return json.dumps(
        {k: dataclasses.asdict(v) if dataclasses.is_dataclass(v) else v for k, v in config.items()}, default=str
    )


def experiment_record(
    name: str, bounds: DataFrame, per_fold: DataFrame, metrics: tuple[str, ...], config: dict
) -> DataFrame:
    """One row per experiment with its folds nested: bounds of each segment and a metric map.

    Folds are few by configuration, so nesting them into one row is safe; append it with ``record_experiment``.
    """
    pairs = [x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]
    fold = F.struct("fold_id", *[c for c in bounds.columns if c != "fold_id"], F.create_map(*pairs).alias("metrics"))
    nested = bounds.join(per_fold.select("fold_id", *metrics), "fold_id").agg(
        F.collect_list(fold).alias("folds"),
        F.count(F.lit(1)).alias("n_folds"),
    )
    return nested.select(
        F.lit(name).alias("experiment"),
        F.current_timestamp().alias("created_at"),
        F.lit(plain_config(config)).alias("config"),
        "n_folds",
        F.array_sort("folds", lambda a, b: a["fold_id"] - b["fold_id"]).alias("folds"),
    )
