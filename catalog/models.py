"""Model queries at full size. What a fitted forecaster gives has no SQL twin, so each query states what SQL can check of
it: its rows, labels and counts, that probabilities sum to one and quantiles are ordered, and that it beats a plain guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeworks.config import LABELS, QUANTILES, BoostConfig, CostModel, DecisionConfig
from tapeworks.models.classifiers import CostHeads, DirichletCalibrator, OpportunityClassifier
from tapeworks.models.forests import expanding_backtest, static_split_forest
from tapeworks.models.quantiles import QuantileForecaster
from tapeworks.operators.intraday import TARGET
from tapeworks.operators.metrics import P_COLUMNS
from tapeworks.operators.news import tagged_news
from tapeworks.operators.trend import HORIZONS, next_day_target, trend_columns, trend_features
from tapeworks.plans import backtest as study_plan
from tapeworks.plans.feature_tables import BAR_FEATURES, SESSION_FEATURES, bar_feature_table, session_feature_table
from tapeworks.runtime import materialize

from .fixtures import LABEL, LAYOUT, Fixture
from .labels import fixture_labels
from .news import wire
from .registry import day, q6s, query, rounded, view
from .trading import forecast_sql

# Trees and leaves as by default; the smallest leaf is lowered to the fixture's month of sessions.
SESSION_MODEL = BoostConfig(min_rows_per_leaf=5)
BAR_MODEL = BoostConfig(min_rows_per_leaf=20)
STUDY = study_plan.StudyConfig(
    LAYOUT,
    LABEL,
    session_model=SESSION_MODEL,
    bar_model=BAR_MODEL,
    decisions=DecisionConfig(max_risk_bps=5000.0, trend_oppose_bps=3000.0),
    min_score=0.05,
    max_candidates=2,
    top_k=2,
)


def wired(fx: Fixture) -> DataFrame:
    return tagged_news(wire(fx), fx.tags)


def summed() -> Column:
    """Probabilities lie between 0 and 1 and sum to one."""
    ranged = [F.col(p).between(-1e-9, 1 + 1e-9) for p in P_COLUMNS]
    total = sum((F.col(p) for p in P_COLUMNS), F.lit(0.0))
    return ranged[0] & ranged[1] & ranged[2] & (F.abs(total - 1) < 1e-9)


def log_loss(p: Column) -> Column:
    return F.avg(-F.ln(F.greatest(p, F.lit(1e-9))))


def of_label(prefix: str) -> Column:
    return F.coalesce(*[F.when(F.col("label") == x, F.col(f"{prefix}_{x}")) for x in LABELS])


def judged(scored: DataFrame) -> DataFrame:
    """Rows per label, whether all probabilities are sound, and whether those of the training rows beat their shares."""
    n = F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    per = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.bool_and(summed()).alias("sound"), F.sum(-F.ln(F.greatest(of_label("p"), F.lit(1e-9)))).alias("loss"), n.alias("n")
    )
    plain = -F.sum(F.col("n_rows") * F.ln(F.col("n_rows") / F.col("n"))).over(Window.partitionBy())
    loss = F.sum("loss").over(Window.partitionBy())
    return per.select("label", "n_rows", "sound", (loss <= plain + 1e-6).alias("beats_shares"))


JUDGED = "SELECT label, count(*) AS n_rows, true AS sound, true AS beats_shares FROM {0} GROUP BY label"


@view("scored_sessions", "labelled", "snapshots")
def _scored_sessions():
    return "SELECT l.ticker, l.d, l.label FROM labelled l JOIN snapshots s ON s.ticker = l.ticker AND s.d = l.d"


@query("opportunity_classifier", "scored_sessions", sql=JUDGED.format("scored_sessions"))
def _(fx):
    labels = fixture_labels(fx).labels.select("ticker", "date", "label")
    rows = materialize(session_feature_table(fx.bars, fx.calendar, wired(fx)).join(labels, ["ticker", "date"]))  # read by each step of the fit
    return judged(OpportunityClassifier(SESSION_FEATURES, SESSION_MODEL).fit(rows).predict(rows))


@query("dirichlet_calibrator", "fx_proba", sql=JUDGED.format("fx_proba"))
def _(fx):
    from .trading import probabilities

    rows = probabilities(fx)
    return judged(DirichletCalibrator().fit(rows).transform(rows))


@query(
    "quantile_forecaster",
    "bar_features",
    sql="SELECT ticker, count(fwd_ret_15m) AS n_rows, 0 AS n_crossed, true AS covers, true AS beats_zero FROM bar_features GROUP BY ticker",
)
def _(fx):
    rows = materialize(bar_feature_table(fx.rth, wired(fx)))  # read by each step of the fit
    scored = QuantileForecaster(BAR_FEATURES, BAR_MODEL).fit(rows).predict(rows)
    y = F.col(TARGET)
    pinball = lambda q, at: F.sum(F.greatest(q * (y - at), (q - 1) * (y - at)))
    inside = F.avg(y.between(F.col("q10"), F.col("q90")).cast("double"))
    model = sum((pinball(q, F.col(f"q{round(100 * q)}")) for q in QUANTILES), F.lit(0.0))
    zero = sum((pinball(q, F.lit(0.0)) for q in QUANTILES), F.lit(0.0))
    return scored.groupBy("ticker").agg(
        F.count(y).alias("n_rows"),
        F.count_if((F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90"))).cast("int").alias("n_crossed"),
        inside.between(0.6, 0.98).alias("covers"),
        (model <= zero).alias("beats_zero"),
    )


@query(
    "cost_heads",
    "bar_features",
    sql=f"""SELECT ticker, count(*) AS n_rows, count(CASE WHEN fwd_ret_15m > {CostModel().round_trip_cost} THEN 1 END) AS n_long_wins,
  count(CASE WHEN fwd_ret_15m < -{CostModel().round_trip_cost} THEN 1 END) AS n_short_wins, true AS sound, true AS ranks FROM bar_features GROUP BY ticker""",
)
def _(fx):
    rows, cost = materialize(bar_feature_table(fx.rth, wired(fx))), CostModel().round_trip_cost  # rows are read by each step of the fit
    scored = CostHeads(BAR_FEATURES, cost, BAR_MODEL).fit(rows).predict(rows)
    won, lost = F.col(TARGET) > cost, F.col(TARGET) < -cost
    p, q = F.col("p_long_win"), F.col("p_short_win")
    # Winners get a higher probability than the others on the rows that trained the heads.
    ranks = (F.avg(F.when(won, p)) >= F.avg(F.when(~won, p))) & (F.avg(F.when(lost, q)) >= F.avg(F.when(~lost, q)))
    return scored.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(won).alias("n_long_wins"), F.count_if(lost).alias("n_short_wins"),
        F.bool_and(p.between(0, 1) & q.between(0, 1)).alias("sound"), F.coalesce(ranks, F.lit(True)).alias("ranks"),
    )


@query(
    "static_split_forest",
    "targets",
    sql="SELECT ticker, CAST(d AS VARCHAR) AS date, target, true AS sound FROM (SELECT *, row_number() OVER (PARTITION BY ticker"
    " ORDER BY d DESC) AS back FROM targets) WHERE back <= 100",
)
def _(fx):
    scored = static_split_forest(next_day_target(fx.daily))
    sound = F.col("p_up").between(0, 1) & (F.col("prediction") == (F.col("p_up") >= 0.5).cast("int"))
    return scored.select("ticker", day(), "target", sound.alias("sound"))


# Shipments of the three return states, one after the other: a series long enough for the longest horizon and for refits.
@view("ship_days")
def _ship_days():
    return """SELECT CAST(l_shipdate AS DATE) + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 4000 ELSE 8000 END AS d,
  arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS close FROM lineitem GROUP BY 1"""


def ship_series(fx: Fixture) -> DataFrame:
    moved = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 4000).otherwise(8000)
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return fx.table("lineitem").groupBy(F.lit("ALL").alias("ticker"), F.date_add(F.col("l_shipdate").cast("date"), moved).alias("date")).agg(
        F.max_by("l_extendedprice", place).cast("double").alias("close")
    )


@query(
    "expanding_backtest",
    "ship_days",
    sql="""SELECT CAST(d AS VARCHAR) AS date, CAST(coalesce(tomorrow > close, false) AS INT) AS target, true AS sound
FROM (SELECT *, lead(close) OVER (ORDER BY d) AS tomorrow, row_number() OVER (ORDER BY d) AS n FROM ship_days) WHERE n > 1000 + 2500""",
)
def _(fx):
    rows = trend_features(next_day_target(ship_series(fx)))
    scored = expanding_backtest(rows, tuple(trend_columns(HORIZONS)))
    sound = F.col("p_up").between(0, 1) & (F.col("prediction") == (F.col("p_up") >= 0.6).cast("int"))
    return scored.select(day(), "target", sound.alias("sound"))


def study(fx: Fixture):
    return study_plan.prepare(fx.bars, fx.calendar, STUDY, wired(fx))


def per_fold(fx: Fixture, run) -> DataFrame:
    ready = study(fx)
    return study_plan.walk_forward_run(ready.fold_ids, lambda k: run(ready, k))


@view("test_sessions", "fold_labels", "snapshots")
def _test_sessions():
    return """SELECT l.fold_id, l.ticker, l.d, l.label FROM fold_labels l JOIN snapshots s ON s.ticker = l.ticker AND s.d = l.d
WHERE l.segment = 'test'"""


@query(
    "session_model_metrics",
    "test_sessions",
    sql="""SELECT fold_id, version, count(*) AS n_rows, true AS sound FROM test_sessions, (SELECT unnest(['calibrated', 'raw']) AS version)
GROUP BY fold_id, version""",
)
def _(fx):
    done = per_fold(fx, study_plan.session_model_metrics)
    sound = (F.col("log_loss") >= 0) & F.col("brier").between(0, 2) & F.col("accuracy").between(0, 1)
    return done.select("fold_id", "version", "n_rows", sound.alias("sound"))


@query(
    "session_rankings",
    "test_sessions",
    sql="""SELECT fold_id, ranker, true AS sound FROM (SELECT DISTINCT fold_id FROM test_sessions),
  (SELECT unnest(['model', 'gap', 'pm_vol', 'random']) AS ranker)""",
)
def _(fx):
    done = per_fold(fx, study_plan.session_rankings)
    sound = F.col("p_at_2").between(0, 1) & F.coalesce(F.col("capture_at_2").between(0, 1), F.lit(True))
    return done.select("fold_id", "ranker", sound.alias("sound"))


@view("zero_forecasts", "bar_features", "folds")
def _zero_forecasts():
    rows = "(SELECT b.*, f.fold_id, 0.0 AS q10, 0.0 AS q50, 0.0 AS q90 FROM bar_features b JOIN folds f ON f.d = b.d AND f.segment = 'test')"
    return forecast_sql(rows, "fold_id")


BASELINE = tuple(f"baseline_pinball_q{round(100 * q)}" for q in QUANTILES)


@query("bar_model_metrics", "zero_forecasts", sql=f"SELECT fold_id, n_rows, {q6s(*BASELINE)}, true AS sound FROM zero_forecasts")
def _(fx):
    done = per_fold(fx, study_plan.bar_model_metrics)
    sound = F.col("coverage_80").between(0, 1) & (F.col("interval_width") >= 0)
    return done.select("fold_id", "n_rows", *rounded(*BASELINE), sound.alias("sound"))


@view("test_days", "folds")
def _test_days():
    return "SELECT fold_id, count(DISTINCT d) AS n_days FROM folds WHERE segment = 'test' GROUP BY fold_id"


@query("end_to_end_backtest", "test_days", sql="SELECT fold_id, n_days, true AS sound FROM test_days")
def _(fx):
    ready = study(fx)
    done = study_plan.end_to_end_backtest(ready)
    # At most two candidates a day and one position at a time bound the trades; days with candidates are test days.
    bound = F.col("n_trades") <= F.col("n_days") * STUDY.max_candidates * 26
    sound = bound & (F.col("n_trades") == F.col("n_long") + F.col("n_short")) & (F.col("candidate_days") <= F.col("n_days"))
    sound = sound & (F.col("n_candidates") <= STUDY.max_candidates * F.col("candidate_days"))
    return done.summary.select("fold_id", "n_days", sound.alias("sound"))


@query(
    "breakout_study",
    "arm_summaries",
    sql=f"SELECT fold_id, n_trades, n_long, n_short, {q6s('hit_rate', 'avg_net_bps', 'total_net_return')}, true AS gated_fewer FROM arm_summaries WHERE arm = 'pure'",
)
def _(fx):
    summary, _ = study_plan.breakout_study(study(fx), fx.rth)
    gated = summary.filter("arm = 'gated'").select("fold_id", F.col("n_trades").alias("gated"))
    both = summary.filter("arm = 'pure'").join(gated, "fold_id")
    numbers = rounded("hit_rate", "avg_net_bps", "total_net_return")
    return both.select("fold_id", "n_trades", "n_long", "n_short", *numbers, (F.col("gated") <= F.col("n_trades")).alias("gated_fewer"))


@query("ablation_study", "zero_forecasts", sql=f"SELECT fold_id, n_rows, {q6s(*BASELINE)}, true AS sound FROM zero_forecasts")
def _(fx):
    forecasts, trades = study_plan.ablation_study(study(fx))
    part = forecasts.filter("slice = 'cand'").select("fold_id", F.col("n_rows").alias("n_cand"))
    both = forecasts.filter("slice = 'all'").join(part, "fold_id", "left").join(trades.filter("slice = 'all'").select("fold_id", "n_trades"), "fold_id")
    sound = (F.coalesce("n_cand", F.lit(0)) <= F.col("n_rows")) & (F.col("n_trades") >= 0)
    return both.select("fold_id", "n_rows", *rounded(*BASELINE), sound.alias("sound"))
