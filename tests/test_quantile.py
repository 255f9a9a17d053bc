import random
import statistics

from tapeworks.operators.quantile import grouped_median


def test_medians_are_exact_for_small_large_even_and_tied_groups(spark):
    rng = random.Random(2)
    groups = {
        "one": [3.0],
        "two": [1.0, 4.0],
        "odd": [5.0, 1.0, 2.0],
        "even": [rng.gauss(0, 1) for _ in range(30_000)],
        "long": [rng.gauss(0, 1) for _ in range(30_001)],
        "tied": [0.0] * 9_000 + [rng.gauss(0, 1) for _ in range(9_001)],
        "half": [1.0] * 500 + [2.0] * 500,
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("one", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: r["median"] for r in grouped_median(frame, "v", "k").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}
