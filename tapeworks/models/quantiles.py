"""Quantile regression by gradient boosting on the pinball loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import QUANTILES, BoostConfig
from ..functions.scalars import sorted_quantiles
from ..operators.intraday import TARGET
from .boosting import Objective, boost

NAMES = tuple(f"q{round(100 * q)}" for q in QUANTILES)


class QuantileForecaster:
    """q10, q50 and q90 of the forward return, sorted within each row: one boosted ensemble each, grown side by side.

    Trees follow the gradient of the pinball loss; their leaves are refitted to the quantile of the residuals there, from counts of
    binned residuals over all rows.
    """

    def __init__(self, columns: tuple[str, ...], config: BoostConfig = BoostConfig(min_rows_per_leaf=200)):
        self.columns, self.config = columns, config

    def fit(self, train: DataFrame) -> QuantileForecaster:
        rows = train.na.drop(subset=[TARGET])
        self.model = boost(rows, self.columns, {"_y": F.col(TARGET)}, Objective("quantile", len(QUANTILES), QUANTILES), self.config)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c not in NAMES]
        scored = rows.select(*kept, self.model.column().alias("_q"))
        return scored.withColumns({n: F.col("_q")[i] for i, n in enumerate(NAMES)}).select(*kept, *sorted_quantiles(*NAMES))
