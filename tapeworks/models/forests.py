"""Random-forest direction models of a daily series: one static split, and an expanding refit."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import threshold_flag
from ..runtime import materialize, runs_at_once

# Predictors of the first model, and the probability from which a rise is called.
RAW_PREDICTORS = ("close", "volume", "open", "high", "low")
CALL_FLOOR = 0.6


def numbered(daily: DataFrame) -> DataFrame:
    """Rows of one series by position: one row per trading day, so the ordering window stays calendar-sized."""
    return daily.withColumn("row_no", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def fit_predict(
    train: DataFrame, test: DataFrame, predictors: tuple[str, ...], trees: int, min_split: int, seed: int = 1
) -> DataFrame:
    """Test rows with p_up. ``min_split`` maps to MLlib's smallest leaf (half of it)."""
    assembler = VectorAssembler(inputCols=list(predictors), outputCol="features")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="target", numTrees=trees, minInstancesPerNode=max(1, min_split // 2), seed=seed
    )
    model = forest.fit(assembler.transform(train.na.drop(subset=[*predictors, "target"])))
    scored = model.transform(assembler.transform(test.na.drop(subset=list(predictors))))
    p = vector_to_array("probability")
    return scored.withColumn("p_up", p[1]).drop("features", "rawPrediction", "probability", "prediction")


def static_split_forest(
    daily: DataFrame, predictors: tuple[str, ...] = RAW_PREDICTORS, held: int = 100, trees: int = 100, min_split: int = 100
) -> DataFrame:
    """Fit on all but the last ``held`` rows of each ticker and predict those."""
    left = F.count(F.lit(1)).over(Window.partitionBy("ticker")) - F.col("row_no")
    rows = numbered(daily).withColumn("left", left)
    train, test = rows.filter(F.col("left") > held), rows.filter(F.col("left") <= held)
    scored = fit_predict(train.drop("left"), test.drop("left"), predictors, trees, min_split)
    return scored.withColumn("prediction", threshold_flag(F.col("p_up"), 0.5))


def expanding_backtest(
    daily: DataFrame,
    predictors: tuple[str, ...],
    start: int = 2500,
    step: int = 250,
    trees: int = 200,
    min_split: int = 50,
) -> DataFrame:
    """Refit on all earlier rows every ``step`` rows from ``start`` on, and predict the next ``step``; refits run side by side."""
    rows = materialize(numbered(daily.na.drop(subset=list(predictors))))  # read by every refit
    n = (rows.agg(F.max("row_no")).first()[0] or 0) + 1
    firsts = range(start, n, step)
    if not firsts:
        raise ValueError(f"{n} rows are too few for a first prediction at row {start}")

    def refit(first: int) -> DataFrame:
        test = rows.filter(F.col("row_no").between(first, first + step - 1))
        return fit_predict(rows.filter(F.col("row_no") < first), test, predictors, trees, min_split)

    scored = runs_at_once(firsts, refit, "first_row").drop("first_row")
    return scored.withColumn("prediction", threshold_flag(F.col("p_up"), CALL_FLOOR))
