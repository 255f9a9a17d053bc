import pytest
from pyspark.sql import functions as F

from frames import DAY, bars, collected, instants
from tapeworks.config import CostModel, LabelConfig, WalkForwardConfig
from tapeworks.operators.folds import fold_bounds, holdout_days, walk_forward_folds
from tapeworks.operators.labels import classify_sessions, qualify_windows
from tapeworks.operators.tod import tod_stats_fit, tod_transform
from tapeworks.operators.windows import session_windows

WINDOW = (
    "ticker string, date date, slot int, open_min int, r_w double, dollar_vol double, trade_count bigint, "
    "active_subbar_fraction double, z_move double, dollar_vol_pctile double, trades_pctile double"
)


def test_windows_keep_empty_slots_and_use_close_without_vwap(spark):
    rows = instants(bars(spark, [(570, 100.0, 101.0, 99.0, 100.0, 10.0), (580, 100.0, 103.0, 99.0, 102.0, 0.0), (590, 50.0, 51.0, 49.0, 55.0, 4.0)]))
    grid = spark.createDataFrame([("AAA", DAY, 570, 630)], "ticker string, date date, open_min int, close_min int")
    got = session_windows(rows.withColumns({"open_min": F.lit(570), "close_min": F.lit(630)}), grid).orderBy("slot").collect()
    assert [r["slot"] for r in got] == [570, 585, 600, 615]
    assert got[0]["r_w"] == pytest.approx(abs(__import__("math").log(102 / 100)))
    assert got[0]["dollar_vol"] == 1000.0 and got[0]["active_subbar_fraction"] == pytest.approx(1 / 3)
    assert got[1]["n_subbars"] == 1 and got[1]["dollar_vol"] == 220.0
    assert got[2]["r_w"] is None and got[2]["dollar_vol"] == 0.0 and got[2]["trade_count"] == 0


def test_tod_untrusted_slots_and_unknown_moves_stay_unknown(spark):
    schema = "ticker string, date date, slot int, r_w double, dollar_vol double, trade_count bigint"
    train = spark.createDataFrame([("A", DAY, 570, x, x * 10, int(x)) for x in (1.0, 2.0, 3.0, 4.0, 5.0)] + [("A", DAY, 585, 1.0, 1.0, 1)], schema)
    rows = spark.createDataFrame([("A", DAY, 570, 4.0, 40.0, 9), ("A", DAY, 570, None, 5.0, 1), ("A", DAY, 585, 1.0, 1.0, 1), ("B", DAY, 570, 1.0, 1.0, 1)], schema)
    got = {(r["ticker"], r["slot"], r["r_w"]): r for r in tod_transform(train, rows, 5, 0.0).collect()}
    hit = got[("A", 570, 4.0)]
    assert (hit["z_move"], hit["dollar_vol_pctile"], hit["trades_pctile"]) == (0.5, 0.8, 1.0)
    for key in (("A", 570, None), ("A", 585, 1.0), ("B", 570, 1.0)):
        assert got[key]["z_move"] is None and got[key]["dollar_vol_pctile"] is None
    assert tod_stats_fit(train, 5).count() == 1


def test_each_criterion_vetoes_and_unknown_never_qualifies(spark):
    good = ("A", DAY, 570, 570, 0.01, 1e6, 80, 1.0, 2.0, 0.9, 0.9)
    cases = [good, (*good[:8], 1.4, 0.9, 0.9), (*good[:4], 0.002, *good[5:]), (*good[:9], 0.6, 0.9), (*good[:6], 40, *good[7:]), (*good[:8], None, None, None)]
    rows = spark.createDataFrame([(*c[:2], 570 + i, *c[3:]) for i, c in enumerate(cases)], WINDOW)
    got = qualify_windows(rows).orderBy("slot").collect()
    assert [r["qualifies"] for r in got] == [True, False, False, False, False, False]
    assert LabelConfig().round_trip_cost == pytest.approx(0.0011) and CostModel().round_trip_cost == pytest.approx(0.0011)
    assert CostModel(impact_bps=3).round_trip_cost == pytest.approx(0.0017)


def test_session_classes(spark):
    hits = {"A": [], "B": [570, 600], "C": [570, 660, 900], "D": [660]}
    rows = [(t, DAY, 570, s, s in h) for t, h in hits.items() for s in (570, 600, 660, 900, 945)]
    labelled = classify_sessions(spark.createDataFrame(rows, "ticker string, date date, open_min int, slot int, qualifies boolean"))
    got = {r["ticker"]: (r["label"], r["n_qualifying"], r["n_opening"], r["n_late"], r["n_windows"]) for r in labelled.collect()}
    assert got == {
        "A": ("none", 0, 0, 0, 5), "B": ("opening_only", 2, 2, 0, 5), "C": ("sustained", 3, 1, 2, 5), "D": ("opening_only", 1, 0, 1, 5),
    }


@pytest.fixture(scope="module")
def days(spark):
    return spark.range(300).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))


def positions(df):
    origin = __import__("datetime").date(2024, 1, 1)
    return {(r["fold_id"], s): (None if r[f"{s}_from"] is None else ((r[f"{s}_from"] - origin).days, (r[f"{s}_to"] - origin).days)) for r in df.collect() for s in ("train", "calibrate", "test")}


def test_fold_layout(days):
    config = WalkForwardConfig(100, 20, 20, calibrate_sessions=10, embargo_sessions=2, holdout_sessions=30)
    spans = positions(fold_bounds(walk_forward_folds(days, config)))
    assert spans[(0, "train")] == (0, 99) and spans[(0, "calibrate")] == (102, 111) and spans[(0, "test")] == (114, 133)
    assert spans[(1, "train")] == (20, 119)
    assert max(k for k, _ in spans) + 1 == config.fold_count(300) == 7
    assert max(v[1] for (k, s), v in spans.items() if s == "test") < 270
    assert holdout_days(days, config).count() == 30


def test_expanding_folds_and_single_embargo(days):
    spans = positions(fold_bounds(walk_forward_folds(days, WalkForwardConfig(100, 20, 50, embargo_sessions=3, expanding=True))))
    assert spans[(1, "train")] == (0, 149) and spans[(1, "test")] == (153, 172) and spans[(0, "calibrate")] is None
    with pytest.raises(ValueError):
        WalkForwardConfig(0, 1, 1)
    assert walk_forward_folds(days.limit(50), WalkForwardConfig(100, 20, 20)).count() == 0
