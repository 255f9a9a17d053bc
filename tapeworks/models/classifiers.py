"""Session-opportunity classifier, its calibrator, and the beat-the-cost heads."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..config import BoostConfig
from ..functions.scalars import linear_score, log_probability
from ..operators.intraday import TARGET
from ..operators.metrics import P_COLUMNS, label_index
from .boosting import Objective, boost

def seen_classes(rows: DataFrame, condition: Column) -> list[int]:
    """The classes (0, 1, ...) that the rows hold."""
    return sorted(r[0] for r in rows.select(condition.cast("int")).distinct().collect() if r[0] is not None)


class OpportunityClassifier:
    """Probabilities of the three session classes: boosted heads on the log loss, normalised over the classes that training saw."""

    def __init__(self, columns: tuple[str, ...], config: BoostConfig = BoostConfig()):
        self.columns, self.config = columns, config

    def fit(self, train: DataFrame) -> OpportunityClassifier:
        rows = train.na.drop(subset=["label"])
        label = label_index(F.col("label"))
        self.seen = seen_classes(rows, label)
        self.model = None
        if len(self.seen) > 1:
            heads = {f"_is_{k}": label == k for k in self.seen}
            self.model = boost(rows, self.columns, heads, Objective("softmax", len(heads)), self.config)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add p_none, p_opening_only, p_sustained and opportunity_score; a class that training never saw has probability 0."""
        kept = [c for c in rows.columns if c not in P_COLUMNS]
        scored = rows.select(*kept, (F.array(F.lit(1.0)) if self.model is None else self.model.column()).alias("_p"))
        shares = {p: F.col("_p")[self.seen.index(i)] if i in self.seen else F.lit(0.0) for i, p in enumerate(P_COLUMNS)}
        return scored.withColumns(shares).drop("_p").withColumn("opportunity_score", linear_score())


class DirichletCalibrator:
    """Multinomial logistic regression on log-probabilities, fitted on rows the classifier never saw."""

    def __init__(self, strength: float = 1.0):
        self.strength = strength

    def fit(self, rows: DataFrame) -> DirichletCalibrator:
        known = rows.filter(F.col("label").isNotNull()).withColumn("_y", label_index(F.col("label")))
        counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.seen = sorted(counts)
        self.model = None
        if len(self.seen) > 1:
            dense = F.array_position(F.array(*[F.lit(c) for c in self.seen]), F.col("_y")) - 1
            self.model = LogisticRegression(
                featuresCol="_logs",
                labelCol="_dense",
                family="multinomial",
                maxIter=1000,
                tol=1e-6,
                standardization=False,
                regParam=1.0 / (self.strength * sum(counts.values())),
            ).fit(self._logs(known).withColumn("_dense", dense.cast("double")))
            self.model.setRawPredictionCol("_raw").setProbabilityCol("_p").setPredictionCol("_hat")
        return self

    @staticmethod
    def _logs(rows: DataFrame) -> DataFrame:
        names = [f"_ln_{p}" for p in P_COLUMNS]
        logs = rows.withColumns({n: log_probability(F.col(p)) for n, p in zip(names, P_COLUMNS)})
        return VectorAssembler(inputCols=names, outputCol="_logs").transform(logs).drop(*names)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Replace the class probabilities (and the score); a class missing from the fit keeps probability 0."""
        if self.model is None:
            fixed = {p: F.lit(1.0 if i in self.seen else 0.0) for i, p in enumerate(P_COLUMNS)}
            return rows.withColumns(fixed).withColumn("opportunity_score", linear_score())
        scored = self.model.transform(self._logs(rows)).withColumn("_pa", vector_to_array("_p"))
        found = {
            p: F.col("_pa")[self.seen.index(i)] if i in self.seen else F.lit(0.0) for i, p in enumerate(P_COLUMNS)
        }
        clean = scored.withColumns(found).drop("_logs", "_raw", "_p", "_hat", "_pa")
        return clean.withColumn("opportunity_score", linear_score())


class CostHeads:
    """P(forward return > cost) and P(forward return < -cost): two boosted heads of their own over the same rows."""

    def __init__(self, columns: tuple[str, ...], cost: float, config: BoostConfig = BoostConfig(min_rows_per_leaf=200)):
        self.columns, self.cost, self.config = columns, cost, config

    def fit(self, train: DataFrame) -> CostHeads:
        rows = train.na.drop(subset=[TARGET])
        wins = {"p_long_win": F.col(TARGET) > self.cost, "p_short_win": F.col(TARGET) < -self.cost}
        ranges = rows.agg(*[f(w.cast("int")).alias(f"{n}_{f.__name__}") for n, w in wins.items() for f in (F.min, F.max)]).first()
        self.fixed = {n: float(ranges[f"{n}_min"] or 0) for n in wins if ranges[f"{n}_min"] == ranges[f"{n}_max"]}
        heads = {n: w for n, w in wins.items() if n not in self.fixed}
        self.heads = list(heads)
        self.model = boost(rows, self.columns, heads, Objective("logistic", len(heads)), self.config) if heads else None
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add p_long_win and p_short_win; what always or never held in training has probability 1 or 0."""
        if self.model is not None:
            rows = rows.withColumn("_p", self.model.column())
        found = {n: F.col("_p")[i] for i, n in enumerate(self.heads)} | {n: F.lit(p) for n, p in self.fixed.items()}
        return rows.withColumns({n: found[n] for n in ("p_long_win", "p_short_win")}).drop("_p")
