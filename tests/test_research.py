"""As-of join, day-block intervals, drift, trip monitor and deflated Sharpe against plain Python, with ties, nulls and skew."""

import datetime as dt
import math
import random
from collections import Counter
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.normal import normal_cdf, normal_quantile
from tapeworks.operators.asof_join import asof_join
from tapeworks.operators.drift import feature_drift
from tapeworks.operators.monitor import cooled_down, crossings, strongest
from tapeworks.operators.resampling import bootstrap_means, day_weight, poisson_steps
from tapeworks.operators.selection import deflated_sharpe

LEFT, RIGHT = "k string, t long, id int", "k string, at long, v int, w string"


def plain_asof(left, right, within=None, strict=False):
    result = []
    for k, t, i in left:
        fits = [(at, v, w) for kk, at, v, w in right if kk is not None and kk == k and at is not None and t is not None and (at < t if strict else at <= t)]
        best = max(fits, key=lambda r: (r[0], r[1], r[2]), default=(None, None, None))
        result.append((i, *best) if within is None or best[0] is None or t - best[0] <= within else (i, None, None, None))
    return sorted(result)


@pytest.mark.parametrize("within,strict", [(None, False), (None, True), (30, False), (7, True)])
def test_asof_join_equals_a_search(spark, within, strict):
    rng = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", "never", None]
    left = [(rng.choice(keys), rng.choice([rng.randrange(-300, 300), None, 0, 50]), i) for i in range(400)]
    right = [(rng.choice([k for k in keys if k != "never"]), rng.choice([rng.randrange(-300, 300), None, 0, 50]), rng.randrange(5), rng.choice("xyz")) for _ in range(150)]
    for bucket in (1, 50, 10_000):
        rows = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ("k",), "t", "at", ("v", "w"), bucket, within, strict)
        assert sorted((r["id"], r["at"], r["v"], r["w"]) for r in rows.collect()) == plain_asof(left, right, within, strict)


def test_asof_join_without_rows(spark):
    left, right = spark.createDataFrame([("a", 5, 1), ("a", 5, 1)], LEFT), spark.createDataFrame([], RIGHT)
    assert [(r["id"], r["at"]) for r in asof_join(left, right, ("k",), "t", "at", ("v",), 10).collect()] == [(1, None), (1, None)]
    assert asof_join(left.limit(0), right, ("k",), "t", "at", ("v",), 10).collect() == []


def test_a_hot_key_is_split_by_time(spark):
    """All windows over rows are laid out by (key, bucket); only one row for each bucket is laid out by the key alone."""
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 1000).alias("t"), F.col("id").cast("int"))
    right = left.select("k", F.col("t").alias("at"), F.col("id").alias("v"), F.lit("x").alias("w"))
    rows = asof_join(left, right, ("k",), "t", "at", ("v",), 50)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_b#" in line.split("windowspecdefinition(")[1].split("_side")[0].split(" ASC")[0] for line in windows) >= 1
    assert rows.filter("k = 'hot' AND at = t").count() == 2000


def test_bootstrap_weights_and_interval(spark):
    days = spark.range(20_000).select(F.lit(1).alias("replicate"), F.col("id").alias("date"))
    counts = Counter(r[0] for r in days.select(day_weight("replicate", "date", 5)).collect())
    for k in range(4):
        assert abs(counts[k] / 20_000 - math.exp(-1) / math.factorial(k)) < 0.01
    assert poisson_steps() == sorted(poisson_steps()) and poisson_steps()[-1] < 2**32
    rng = random.Random(1)
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=d), rng.gauss(0.5, 1) + 2 * (d % 2)) for d in range(60) for _ in range(3)]
    frame = spark.createDataFrame([*rows, ("a", dt.date(2024, 1, 1), None)], "k string, date date, x double")
    got = bootstrap_means(frame, "x", ("k",), 500).first()
    assert (got["n_days"], got["n_rows"]) == (60, 180) and got["low"] < got["mean"] < got["high"]
    rows_apart = 1.96 * math.sqrt(sum((x - got["mean"]) ** 2 for *_, x in rows)) / 180
    assert got["high"] - got["low"] > 2 * rows_apart  # days that differ widen it beyond that of independent rows
    again = bootstrap_means(frame.repartition(7), "x", ("k",), 500).first()
    assert abs(again["low"] - got["low"]) < 1e-12 and abs(again["high"] - got["high"]) < 1e-12


def test_drift_of_moved_and_unmoved_features(spark):
    rng = random.Random(2)
    rows = [(0, s, rng.gauss(0, 1), rng.gauss(1.0 if s == "test" else 0, 1), None if s == "test" and rng.random() < 0.5 else 1.0, None) for s in ("train", "test") for _ in range(2000)]
    frame = spark.createDataFrame(rows, "fold_id int, segment string, still double, moved double, gone double, never double")
    got = {r["feature"]: r for r in feature_drift(frame, ("still", "moved", "gone", "never")).collect()}
    assert got["still"]["psi"] < 0.05 < 0.5 < got["moved"]["psi"] and got["gone"]["psi"] > 0.5
    assert set(got) == {"still", "moved", "gone"} and {r["segment"] for r in got.values()} == {"test"} and got["still"]["n_rows"] == 2000
    assert feature_drift(frame.limit(0), ("still",)).collect() == []


def greedy(times, wait):
    kept = []
    for t in sorted(set(times)):
        if not kept or t >= kept[-1] + wait:
            kept.append(t)
    return kept


@pytest.mark.parametrize("wait", [1, 5, 40])
def test_cooldown_equals_the_greedy_rule(spark, wait):
    rng = random.Random(wait)
    rows = [(k, rng.randrange(300), 1) for k in "abc" for _ in range(rng.choice([1, 30, 200]))] + [("one", 7, 1), ("one", 7, 2)]
    got = cooled_down(spark.createDataFrame(rows, "ticker string, t int, n int"), ("ticker",), "t", wait).collect()
    want = [(k, t) for k in {r[0] for r in rows} for t in greedy([t for kk, t, _ in rows if kk == k], wait)]
    assert sorted((r["ticker"], r["t"]) for r in got) == sorted(want)


def test_crossings_with_hysteresis_and_limit(spark):
    values = [None, 1.6, 1.2, 1.7, 0.9, 1.4, 1.5, None, 2.0, 0.5, 3.0]
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 2), 570 + 5 * i, v) for i, v in enumerate(values)], "ticker string, date date, minute int, x double")
    on = crossings(rows, "x", 1.5, 1.0)
    assert [(r["minute"] - 570) // 5 for r in on.orderBy("minute").collect()] == [1, 6, 10]
    most = strongest(on, "minute", 1000, "x", 2).collect()
    assert sorted(r["x"] for r in most) == [1.6, 3.0]
    assert cooled_down(rows.limit(0), ("ticker",), "minute", 5).collect() == []


def test_normal_distribution(spark):
    xs = [-9.0, -8.0, -3.3, -1.0, 0.0, 0.1, 1.96, 4.0, 7.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - NormalDist().cdf(max(r["x"], -8.5))) < 1e-13 for r in got)
    ps = [1e-9, 1e-4, 0.025, 0.3, 0.5, 0.6, 0.95, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("x")).collect()
    assert all(abs(r["x"] - NormalDist().inv_cdf(r["p"])) < 1e-6 for r in got)
    odd = spark.createDataFrame([(None,), (0.0,), (1.0,), (2.0,)], "p double").select(normal_quantile(F.col("p"))).collect()
    assert all(r[0] is None for r in odd)


def test_more_trials_deflate_more(spark):
    rng = random.Random(8)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(250)]
    rows = [(f"s{i}", d, rng.gauss(0.0, 0.01)) for i in range(40) for d in days] + [("skilled", d, rng.gauss(0.004, 0.01)) for d in days]
    frame = spark.createDataFrame(rows, "trial string, date date, ret double")
    all_trials = {r["trial"]: r for r in deflated_sharpe(frame, "ret", "trial").collect()}
    assert all_trials["skilled"]["deflated"] > 0.95 and max(r["deflated"] for t, r in all_trials.items() if t != "skilled") < 0.95
    few = {r["trial"]: r for r in deflated_sharpe(frame.filter("trial IN ('s0', 's1', 's2')"), "ret", "trial").collect()}
    assert few["s0"]["n_trials"] == 3 and few["s0"]["lucky_sharpe"] < all_trials["s0"]["lucky_sharpe"]
    alone = deflated_sharpe(frame.filter("trial = 's0'"), "ret", "trial").first()
    assert alone["lucky_sharpe"] is None and alone["deflated"] is None
    flat = spark.createDataFrame([("c", days[0], 0.0), ("c", days[1], 0.0), ("d", days[0], None)], "trial string, date date, ret double")
    assert [r["sharpe"] for r in deflated_sharpe(flat, "ret", "trial").collect()] == [None]
