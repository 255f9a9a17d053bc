"""The two-stage study: session classifier -> candidates -> bar forecaster -> decisions -> trades -> realised curve."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..config import BoostConfig, BreakoutConfig, CostModel, DecisionConfig, LabelConfig, RiskConfig, WalkForwardConfig
from ..functions.rolling import SESSION
from ..models.classifiers import CostHeads, DirichletCalibrator, OpportunityClassifier
from ..models.quantiles import QuantileForecaster
from ..operators.asof import distinct_sessions, rth_bars
from ..operators.curve import Curve, realised_curve
from ..operators.decisions import decide, select_candidates
from ..operators.folds import CALIBRATE, TEST, TRAIN, fold_bounds, walk_forward_folds
from ..operators.metrics import class_prior, classifier_metrics, compare_rankers, forecast_metrics
from ..operators.trades import thin_events, trade_summary
from ..operators.windows import session_windows, stored_grid
from ..runtime import bounded_broadcast, materialize, runs_at_once, written
from ..sources.calendar import SESSION_BOUND
from .comparisons import arm_compare, arm_curves, arm_trades, slice_ablation
from .feature_tables import BAR_FEATURES, SESSION_FEATURES, bar_feature_table, session_feature_table
from .labelling import label_folds
from .records import experiment_record

RECORDED = ("n_trades", "n_candidates", "candidate_days", "hit_rate", "avg_net_bps", "total_net_return")


@dataclass(frozen=True)
class StudyConfig:
    layout: WalkForwardConfig
    label: LabelConfig = LabelConfig()
    session_model: BoostConfig = BoostConfig()
    bar_model: BoostConfig = BoostConfig(min_rows_per_leaf=200)
    costs: CostModel = CostModel()
    decisions: DecisionConfig = DecisionConfig()
    risk: RiskConfig = RiskConfig()
    min_score: float = 0.5
    max_candidates: int = 5
    top_k: int = 5


@dataclass
class Study:
    """Feature, label and fold tables, each computed once and shared by all folds."""

    config: StudyConfig
    sessions: DataFrame
    bars: DataFrame
    labels: DataFrame
    folds: DataFrame
    fold_ids: list[int] = field(default_factory=list)


def prepare(bars: DataFrame, calendar: DataFrame, config: StudyConfig, tagged: DataFrame | None = None) -> Study:
    """Build and materialise the tables. ``bars`` are extended-hours bars as of the end of the range.

    News and bars go into several tables: articles are typed once, and bars aggregated once, for all of them.
    """
    bars, tagged = written(bars), None if tagged is None else written(tagged)
    rth = rth_bars(bars, calendar)
    folds = materialize(walk_forward_folds(distinct_sessions(rth), config.layout))
    windows = session_windows(rth, stored_grid(rth))
    return Study(
        config,
        materialize(session_feature_table(bars, calendar, tagged)),
        materialize(bar_feature_table(rth, tagged)),
        materialize(label_folds(windows, folds, config.label).labels.select("fold_id", "segment", *SESSION, "label")),
        folds,
        sorted(r[0] for r in folds.select("fold_id").distinct().collect()),
    )


def walk_forward_run(fold_ids: list[int], run_fold: Callable[[int], DataFrame], in_flight: int = 4) -> DataFrame:
    """Run a fold function for each fold, several at once, and give its rows with their fold_id as one written table."""
    if not fold_ids:
        raise ValueError("no folds fit in the requested range")
    return runs_at_once(fold_ids, run_fold, "fold_id", in_flight)


def segment_rows(rows: DataFrame, study: Study, fold: int, segment: str) -> DataFrame:
    days = study.folds.filter((F.col("fold_id") == fold) & (F.col("segment") == segment)).select("date")
    return rows.join(bounded_broadcast(days, SESSION_BOUND), "date", "left_semi")


def labelled_rows(study: Study, fold: int, segment: str) -> DataFrame:
    wanted = study.labels.filter((F.col("fold_id") == fold) & (F.col("segment") == segment))
    return study.sessions.join(wanted.select(*SESSION, "label"), list(SESSION))


def session_scores(study: Study, fold: int) -> tuple[OpportunityClassifier, DirichletCalibrator]:
    """Classifier from the train segment, calibrator from its predictions on the calibrate segment."""
    model = OpportunityClassifier(SESSION_FEATURES, study.config.session_model)
    model.fit(labelled_rows(study, fold, TRAIN))
    calibrator = DirichletCalibrator().fit(model.predict(labelled_rows(study, fold, CALIBRATE)))
    return model, calibrator


def session_model_metrics(study: Study, fold: int) -> DataFrame:
    """Calibrated and raw classifier metrics on the test segment, with the training prior as reference."""
    model, calibrator = session_scores(study, fold)
    raw = model.predict(labelled_rows(study, fold, TEST))
    prior = class_prior(labelled_rows(study, fold, TRAIN)).first().asDict()
    calibrated = calibrator.transform(raw).withColumns({k: F.lit(v) for k, v in prior.items()})
    done = classifier_metrics(calibrated.withColumn("version", F.lit("calibrated")), "version")
    plain = classifier_metrics(raw.withColumn("version", F.lit("raw")), "version")
    return done.unionByName(plain, allowMissingColumns=True)


def session_rankings(study: Study, fold: int) -> DataFrame:
    model, calibrator = session_scores(study, fold)
    return compare_rankers(calibrator.transform(model.predict(labelled_rows(study, fold, TEST))), study.config.top_k)


def score_test_days(study: Study, fold: int) -> DataFrame:
    """Calibrated opportunity score of every test-day session."""
    model, calibrator = session_scores(study, fold)
    scored = calibrator.transform(model.predict(segment_rows(study.sessions, study, fold, TEST)))
    return scored.select(*SESSION, F.col("opportunity_score").alias("score"))


def fold_candidates(study: Study, fold: int) -> DataFrame:
    """(ticker, date) picked on test days: score floor, then at most ``max_candidates`` a day."""
    return select_candidates(score_test_days(study, fold), study.config.min_score, study.config.max_candidates)


def fold_watchlist(study: Study, fold: int) -> DataFrame:
    """Every (ticker, date) over the score floor, without a daily limit."""
    return select_candidates(score_test_days(study, fold), study.config.min_score, None)


def forecast(study: Study, fold: int, rows: DataFrame) -> DataFrame:
    """Quantile forecasts (and win probabilities when the decisions use them) for ``rows`` from the train segment."""
    train = segment_rows(study.bars, study, fold, TRAIN)
    predicted = QuantileForecaster(BAR_FEATURES, study.config.bar_model).fit(train).predict(rows)
    if study.config.decisions.min_p_win > 0:
        heads = CostHeads(BAR_FEATURES, study.config.costs.round_trip_cost, study.config.bar_model).fit(train)
        predicted = heads.predict(predicted)
    return predicted


@dataclass(frozen=True)
class BacktestResult:
    """``trades`` are those of all folds, stitched; ``summary`` is per fold, ``totals`` across folds."""

    trades: DataFrame
    summary: DataFrame
    totals: DataFrame
    curve: Curve
    record: DataFrame


def end_to_end_backtest(study: Study) -> BacktestResult:
    """All folds: candidates, forecasts on candidate sessions only, decisions, thinning, summaries, stitched curve."""
    config = study.config

    picked = walk_forward_run(study.fold_ids, lambda k: fold_candidates(study, k))

    def decided(fold: int) -> DataFrame:
        listed = picked.filter(F.col("fold_id") == fold).select(*SESSION)
        rows = study.bars.join(listed, list(SESSION), "left_semi")
        return decide(forecast(study, fold, rows), config.costs, config.decisions)

    rows = walk_forward_run(study.fold_ids, decided)
    return stitched(rows, picked, study.folds, config.costs, config.risk, {"study": config})


def stitched(
    rows: DataFrame, picked: DataFrame, folds: DataFrame, costs: CostModel = CostModel(), risk: RiskConfig = RiskConfig(), settings: dict | None = None
) -> BacktestResult:
    """What the decided ``rows`` (with fold_id) of all folds come to: trades, counters per fold, totals, one curve and the record.

    ``picked`` (fold_id, ticker, date) are the candidates that the rows come from. A fold without decisions still reports.
    """
    trades = materialize(thin_events(rows, costs, "fold_id"))
    test_days = folds.filter(F.col("segment") == TEST).groupBy("fold_id").agg(F.count_distinct("date").alias("n_days"))
    chosen = picked.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_distinct("date").alias("candidate_days"))
    counts = rows.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_decision_rows"))
    known = test_days.join(counts, "fold_id", "left").join(chosen, "fold_id", "left")
    universe = known.fillna(0, ["n_decision_rows", "n_candidates", "candidate_days"])
    counters = universe.select("fold_id", "n_days", "n_candidates", "candidate_days")
    summary = trade_summary(trades, universe, "fold_id").join(counters, "fold_id")
    record = experiment_record("end_to_end_backtest", fold_bounds(folds), summary, RECORDED, settings or {})
    curve = realised_curve(trades.withColumn("run_id", F.lit("stitched")), risk)
    return BacktestResult(trades, summary, fold_totals(summary), curve, record)


def fold_totals(summary: DataFrame) -> DataFrame:
    """Over all folds: trades, summed net return, and the mean hit rate and net result of the folds that traded."""
    traded = F.col("n_trades") > 0
    return summary.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.count_if(traded).alias("n_folds_traded"),
        F.sum("n_trades").alias("n_trades"),
        F.sum("total_net_return").alias("total_net_return"),
        F.avg(F.when(traded, F.col("hit_rate"))).alias("mean_hit_rate"),
        F.avg(F.when(traded, F.col("avg_net_bps"))).alias("mean_net_bps"),
    )


def bar_model_metrics(study: Study, fold: int) -> DataFrame:
    """Forecast metrics of the quantile model on the fold's test bars."""
    test = segment_rows(study.bars, study, fold, TEST)
    return forecast_metrics(forecast(study, fold, test))


def breakout_study(study: Study, rth: DataFrame, breakout: BreakoutConfig = BreakoutConfig()) -> tuple[DataFrame, Curve]:
    """Breakouts on all test sessions against those on the scored watchlist: summaries per (fold, arm), and curves."""
    listed = walk_forward_run(study.fold_ids, lambda k: fold_watchlist(study, k))
    trades = materialize(arm_trades(rth, listed, study.folds, breakout, study.config.costs))
    return arm_compare(trades, study.folds), arm_curves(trades, study.config.risk)


def ablation_study(study: Study) -> tuple[DataFrame, DataFrame]:
    """One forecaster per fold, judged on all test rows and on candidate rows: forecast metrics and trade summaries."""
    picked = walk_forward_run(study.fold_ids, lambda k: fold_candidates(study, k))
    rows = walk_forward_run(study.fold_ids, lambda k: forecast(study, k, segment_rows(study.bars, study, k, TEST)))
    return slice_ablation(rows, picked, study.config.costs, study.config.decisions)
