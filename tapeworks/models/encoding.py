"""Feature vectors for MLlib trees, which take no missing values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class FeatureEncoder:
    """Missing values become the training median plus a flag, so a tree can still split on being unknown."""

    medians: dict[str, float]
    flagged: tuple[str, ...]

    @classmethod
    def fit(cls, train: DataFrame, columns: tuple[str, ...]) -> FeatureEncoder:
        """Medians from a mergeable quantile sketch; columns never seen in training are left out."""
        quantiles = train.approxQuantile(list(columns), [0.5], 0.001)
        medians = {c: q[0] for c, q in zip(columns, quantiles) if q}
        gaps = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in medians]).first()
        return cls(medians, tuple(c for c in medians if gaps[c] > 0))

    def transform(self, rows: DataFrame, output: str = "features") -> DataFrame:
        if not self.medians:
            raise ValueError("no feature has a known value in the training rows")
        filled = {f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.medians.items()}
        flags = {f"_{c}_unknown": F.col(c).isNull().cast("double") for c in self.flagged}
        parts = [*filled, *flags]
        return VectorAssembler(inputCols=parts, outputCol=output).transform(rows.withColumns({**filled, **flags})).drop(*parts)
