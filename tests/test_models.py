import math
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.config import BoostConfig
from tapeworks.models.classifiers import CostHeads, DirichletCalibrator, OpportunityClassifier
from tapeworks.models.encoding import FeatureEncoder
from tapeworks.models.quantiles import QuantileForecaster

LABELS = ("none", "opening_only", "sustained")
P = ("p_none", "p_opening_only", "p_sustained")


def overconfident(spark, n, seed, classes=3):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        g = [rng.gammavariate(a, 1) for a in (4.0, 2.5, 2.0)]
        p = [x / sum(g) for x in g]
        label = rng.choices(LABELS, p)[0]
        sharp = [x**3 for x in p]
        if LABELS.index(label) < classes:
            rows.append((label, *[x / sum(sharp) for x in sharp]))
    return spark.createDataFrame(rows, "label string, p_none double, p_opening_only double, p_sustained double")


def log_loss(df):
    rows = df.collect()
    return -sum(math.log(max(r[f"p_{r['label']}"], 1e-12)) for r in rows) / len(rows)


def test_calibration_helps_overconfident_probabilities(spark):
    fit, test = overconfident(spark, 1500, 1), overconfident(spark, 1500, 2)
    calibrated = DirichletCalibrator().fit(fit).transform(test)
    assert log_loss(calibrated) < log_loss(test) - 0.05
    assert all(sum(r[p] for p in P) == pytest.approx(1.0) for r in calibrated.limit(20).collect())


def test_class_missing_from_the_fit_keeps_probability_zero(spark):
    calibrated = DirichletCalibrator().fit(overconfident(spark, 400, 3, classes=2)).transform(overconfident(spark, 50, 4))
    rows = calibrated.collect()
    assert all(r["p_sustained"] == 0.0 and r["p_none"] + r["p_opening_only"] == pytest.approx(1.0) for r in rows)


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        x = rng.uniform(-1, 1)
        y = 0.01 * x + rng.gauss(0, 0.005)
        rows.append((x if i % 10 else None, float(i % 7), None, y, LABELS[0 if y < 0 else 1 + (y > 0.006)]))
    return spark.createDataFrame(rows, "a double, b double, never double, fwd_ret_15m double, label string").cache()


def test_encoder_fills_flags_and_drops(sample):
    encoder = FeatureEncoder.fit(sample, ("a", "b", "never"))
    assert set(encoder.medians) == {"a", "b"} and encoder.flagged == ("a",)
    assert encoder.transform(sample).first()["features"].size == 3


def test_quantiles_are_ordered_and_cover(sample):
    config = BoostConfig(rounds=40, leaves=7, min_rows_per_leaf=40)
    rows = QuantileForecaster(("a", "b"), config).fit(sample).predict(sample)
    row = rows.agg(
        F.count_if((F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90"))).alias("crossed"),
        F.avg((F.col("fwd_ret_15m").between(F.col("q10"), F.col("q90"))).cast("double")).alias("cover"),
        F.avg(F.abs(F.col("fwd_ret_15m") - F.col("q50"))).alias("mae"),
        F.avg(F.abs("fwd_ret_15m")).alias("zero"),
    ).first()
    assert row["crossed"] == 0 and 0.7 < row["cover"] < 0.9 and row["mae"] < row["zero"]


def test_classifier_and_heads_learn(sample):
    config = BoostConfig(rounds=40, leaves=7, min_rows_per_leaf=20)
    scored = OpportunityClassifier(("a", "b"), config).fit(sample).predict(sample)
    means = scored.groupBy("label").agg(F.avg("opportunity_score").alias("s")).collect()
    score = {r["label"]: r["s"] for r in means}
    assert score["sustained"] > score["none"]
    assert scored.filter(F.abs(F.col("p_none") + F.col("p_opening_only") + F.col("p_sustained") - 1) > 1e-9).count() == 0
    heads = CostHeads(("a", "b"), 0.0011, config).fit(sample).predict(sample)
    gap = heads.agg(F.corr("p_long_win", "fwd_ret_15m"), F.corr("p_short_win", "fwd_ret_15m")).first()
    assert gap[0] > 0.3 and gap[1] < -0.3
