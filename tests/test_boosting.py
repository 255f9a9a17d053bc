"""Boosted ensembles: the same over blocks as over rows at hand, better than a forest, and a plan of one size."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tapeworks.config import QUANTILES, BoostConfig
from tapeworks.models import boosting
from tapeworks.models.boosting import Objective, boost
from tapeworks.models.classifiers import CostHeads, OpportunityClassifier
from tapeworks.models.quantiles import QuantileForecaster

LABELS = ("none", "opening_only", "sustained")
COLUMNS = ("a", "b", "c")
FINE = BoostConfig(rounds=120, leaves=15, min_rows_per_leaf=20)


def rows_of(spark, n, seed):
    """A return whose centre and spread hang on the features, and on whether one of them is known."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        a, b, c = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.gauss(0, 1)
        known = rng.random() < 0.8
        y = 0.01 * a * (1 if b > 0 else -1) + (0 if known else 0.01) + rng.gauss(0, 0.002 + 0.006 * abs(b))
        p = 1 / (1 + math.exp(-4 * a * b))
        label = LABELS[0 if rng.random() > p else 1 + (rng.random() < 0.3 + 0.4 * (b > 0))]
        rows.append((a, b, c if known else None, None, y, label))
    return spark.createDataFrame(rows, "a double, b double, c double, never double, fwd_ret_15m double, label string").cache()


@pytest.fixture(scope="module")
def train(spark):
    return rows_of(spark, 3000, 1)


@pytest.fixture(scope="module")
def held(spark):
    return rows_of(spark, 1500, 2)


@pytest.mark.parametrize("kind", ["quantile", "softmax", "logistic"])
def test_blocks_give_what_one_task_gives(train, kind, monkeypatch):
    config = BoostConfig(rounds=5, leaves=7, min_rows_per_leaf=20)
    y = F.col("fwd_ret_15m")
    targets = {"quantile": {"y": y}, "logistic": {"u": y > 0.001, "d": y < -0.001}, "softmax": {x: F.col("label") == x for x in LABELS}}[kind]
    objective = Objective(kind, 3 if kind != "logistic" else 2, QUANTILES)
    sample = train.limit(600).repartition(5)
    whole = boost(sample, COLUMNS, targets, objective, config)
    monkeypatch.setattr(boosting, "BLOCK", 50)
    monkeypatch.setattr(boosting, "CUT_EVERY", 2)
    parts = boost(sample, COLUMNS, targets, objective, config)
    values = np.array(sample.select(*COLUMNS).fillna(float("nan")).toPandas(), dtype=float)
    assert np.allclose(whole.scores(values), parts.scores(values), atol=1e-9)


def test_quantile_of_counts():
    rng = np.random.default_rng(3)
    edges = np.linspace(-3, 3, 601)
    y = rng.normal(size=5000)
    counts = np.bincount(np.searchsorted(edges, y), minlength=602)[None, :]
    for q in QUANTILES:
        assert abs(boosting.quantile_of_counts(counts, edges, q)[0] - np.quantile(y, q)) < 0.01
    assert boosting.quantile_of_counts(np.zeros((1, 602)), edges, 0.5)[0] == 0


def test_one_split_finds_the_step_and_the_unknown(spark):
    rows = spark.createDataFrame([(float(i % 40) if i % 5 else None, 1.0 if i % 5 == 0 or i % 40 >= 30 else 0.0) for i in range(800)], "x double, y double")
    model = boost(rows, ("x",), {"y": F.col("y")}, Objective("logistic", 1), BoostConfig(rounds=60, leaves=2, min_rows_per_leaf=5, learning_rate=0.3))
    p = model.scores(np.array([[0.0], [29.0], [31.0], [np.nan]]))[0]
    assert p[0] < 0.05 and p[1] < 0.05 and p[2] > 0.95 and p[3] > 0.95
    assert all((t.feature >= 0).sum() <= 1 for t in model.ensemble)


def test_leaves_stay_within_their_number_and_size(train):
    config = BoostConfig(rounds=3, leaves=6, min_rows_per_leaf=100)
    model = boost(train, COLUMNS, {"y": F.col("fwd_ret_15m")}, Objective("quantile", 3, QUANTILES), config)
    bins = boosting._bins_of(np.array(train.select(*COLUMNS).fillna(float("nan")).toPandas(), dtype=float), model.edges)
    for trees in model.ensemble:
        for leaves in trees.leaves(bins, config.depth):
            _, n = np.unique(leaves, return_counts=True)
            assert len(n) <= 6 and n.min() >= 100


def pinball(rows):
    y = F.col("fwd_ret_15m")
    loss = [F.avg(F.greatest(q * (y - F.col(f"q{round(100 * q)}")), (q - 1) * (y - F.col(f"q{round(100 * q)}")))) for q in QUANTILES]
    return rows.agg(sum(loss, F.lit(0.0))).first()[0]


def encoded(rows):
    filled = rows.withColumn("_k", F.col("c").isNull().cast("double")).fillna(0.0, ["c"])
    return VectorAssembler(inputCols=["a", "b", "c", "_k"], outputCol="features").transform(filled)


def test_pinball_below_that_of_a_forest(train, held):
    scored = QuantileForecaster((*COLUMNS, "never"), FINE).fit(train).predict(held)
    forest = RandomForestRegressor(featuresCol="features", labelCol="fwd_ret_15m", leafCol="leaf", numTrees=60, maxDepth=4, minInstancesPerNode=20, seed=1).fit(encoded(train))
    placed = lambda rows: forest.transform(encoded(rows)).select("*", F.posexplode(vector_to_array("leaf")).alias("tree", "at"))
    leaves = placed(train).groupBy("tree", "at").agg(*[F.percentile("fwd_ret_15m", q).alias(f"q{round(100 * q)}") for q in QUANTILES])
    rows = placed(held.withColumn("id", F.monotonically_increasing_id())).join(leaves, ["tree", "at"])
    plain = rows.groupBy("id").agg(F.first("fwd_ret_15m").alias("fwd_ret_15m"), *[F.avg(f"q{round(100 * q)}").alias(f"q{round(100 * q)}") for q in QUANTILES])
    assert pinball(scored) < pinball(plain)
    cover = scored.agg(F.avg(F.col("fwd_ret_15m").between(F.col("q10"), F.col("q90")).cast("double"))).first()[0]
    assert 0.72 < cover < 0.88 and scored.filter("q10 > q50 OR q50 > q90").count() == 0


def test_log_loss_not_above_that_of_a_forest(train, held):
    index = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")) - 1
    forest = RandomForestClassifier(featuresCol="features", labelCol="k", numTrees=60, maxDepth=4, minInstancesPerNode=20, seed=1)
    plain = forest.fit(encoded(train).withColumn("k", index.cast("double"))).transform(encoded(held))
    theirs = plain.agg(F.avg(-F.ln(F.greatest(F.get(vector_to_array("probability"), index.cast("int")), F.lit(1e-9))))).first()[0]
    scored = OpportunityClassifier(COLUMNS, BoostConfig(rounds=80, leaves=7, min_rows_per_leaf=40)).fit(train).predict(held)
    own = F.coalesce(*[F.when(F.col("label") == x, F.col(f"p_{x}")) for x in LABELS])
    assert scored.agg(F.avg(-F.ln(own))).first()[0] <= theirs
    heads = CostHeads(COLUMNS, 0.0011, BoostConfig(rounds=80, leaves=7, min_rows_per_leaf=40)).fit(train).predict(held)
    won = (F.col("fwd_ret_15m") > 0.0011).cast("double")
    plain = forest.fit(encoded(train).withColumn("k", won)).transform(encoded(held)).withColumn("p", vector_to_array("probability")[1])
    loss = lambda p: F.avg(-F.ln(F.greatest(F.when(won == 1, F.col(p)).otherwise(1 - F.col(p)), F.lit(1e-9))))
    assert heads.agg(loss("p_long_win")).first()[0] <= plain.agg(loss("p")).first()[0]


def test_classes_that_training_never_saw(train):
    one = OpportunityClassifier(COLUMNS, FINE).fit(train.filter("label = 'none'")).predict(train).first()
    assert (one["p_none"], one["p_opening_only"], one["p_sustained"]) == (1.0, 0.0, 0.0)
    two = OpportunityClassifier(COLUMNS, BoostConfig(rounds=5)).fit(train.filter("label <> 'opening_only'")).predict(train).first()
    assert two["p_opening_only"] == 0.0 and two["p_none"] + two["p_sustained"] == pytest.approx(1.0)
    never = CostHeads(COLUMNS, 1.0, FINE).fit(train).predict(train).first()
    assert never["p_long_win"] == 0.0 and never["p_short_win"] == 0.0


def test_plan_does_not_grow_with_rounds(train):
    sizes = set()
    for rounds in (2, 40):
        plan = QuantileForecaster(COLUMNS, BoostConfig(rounds=rounds)).fit(train).predict(train)._jdf.queryExecution().optimizedPlan().toString()
        sizes.add(len(plan.splitlines()))
        assert plan.count("boosted(") == 1
    assert len(sizes) == 1
    assert BoostConfig().rounds == 300
