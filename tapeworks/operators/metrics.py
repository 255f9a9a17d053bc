"""Forecast, classification and ranking metrics as grouped aggregates, and their spread over folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import LABELS, NONE, QUANTILES
from ..functions.scalars import argmax_index, log_probability, share
from .intraday import TARGET

P_COLUMNS = tuple(f"p_{label}" for label in LABELS)
FORECAST_METRICS = (
    "pinball_q10", "pinball_q50", "pinball_q90", "coverage_80", "interval_width", "median_mae", "direction_accuracy",
    "baseline_pinball_q10", "baseline_pinball_q50", "baseline_pinball_q90", "pinball_q50_vs_baseline",
)


def pinball(y: Column, prediction: Column, q: float) -> Column:
    miss = y - prediction
    return F.avg(F.greatest(q * miss, (q - 1) * miss))


def forecast_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Quantile loss against the zero forecast, interval coverage and width, median error, direction accuracy."""
    y, zero = F.col(TARGET), F.lit(0.0)
    known = rows.filter(y.isNotNull())
    names = [f"q{int(q * 100)}" for q in QUANTILES]
    same_sign = F.signum("q50") == F.signum(y)
    measured = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[pinball(y, F.col(n), q).alias(f"pinball_{n}") for n, q in zip(names, QUANTILES)],
        share((y >= F.col("q10")) & (y <= F.col("q90"))).alias("coverage_80"),
        F.avg(F.col("q90") - F.col("q10")).alias("interval_width"),
        F.avg(F.abs(y - F.col("q50"))).alias("median_mae"),
        F.avg(F.when(y != 0, F.when(same_sign, 1.0).otherwise(0.0))).alias("direction_accuracy"),
        *[pinball(y, zero, q).alias(f"baseline_pinball_{n}") for n, q in zip(names, QUANTILES)],
    )
    return measured.withColumn("pinball_q50_vs_baseline", F.try_divide("pinball_q50", "baseline_pinball_q50"))


def label_index(label: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in LABELS]), label) - 1).cast("int")


def class_prior(rows: DataFrame, *keys: str) -> DataFrame:
    """Class frequencies of labelled rows, a class that never occurs counting 0."""
    shares = [share(F.col("label") == x).alias(f"prior_{x}") for x in LABELS]
    return rows.filter(F.col("label").isNotNull()).groupBy(*keys).agg(*shares)


def classifier_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Log loss, Brier score, accuracy, per-class precision and recall; log loss of the prior when prior_* exist."""
    known = rows.filter(F.col("label").isNotNull()).withColumns(
        {"_y": label_index(F.col("label")), "_hat": argmax_index(*P_COLUMNS)}
    )
    p = F.array(*[F.col(c) for c in P_COLUMNS])
    p_true = F.get(p, F.col("_y"))
    brier = sum(
        ((F.col(c) - F.when(F.col("_y") == i, 1.0).otherwise(0.0)) ** 2 for i, c in enumerate(P_COLUMNS)), F.lit(0.0)
    )
    # Fixed value: probabilities are clipped at the double's machine epsilon.
    measures = [
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(-log_probability(p_true, 2.220446049250313e-16)).alias("log_loss"),
        F.avg(brier).alias("brier"),
        share(F.col("_hat") == F.col("_y")).alias("accuracy"),
    ]
    if f"prior_{NONE}" in rows.columns:
        prior = F.get(F.array(*[F.col(f"prior_{x}") for x in LABELS]), F.col("_y"))
        measures.append(F.avg(-log_probability(prior)).alias("log_loss_prior"))
    for i, label in enumerate(LABELS):
        hit = F.count_if((F.col("_hat") == i) & (F.col("_y") == i))
        called, real = F.count_if(F.col("_hat") == i), F.count_if(F.col("_y") == i)
        measures.append((hit / F.greatest(called, F.lit(1))).alias(f"precision_{label}"))
        measures.append((hit / F.greatest(real, F.lit(1))).alias(f"recall_{label}"))
    return known.groupBy(*keys).agg(*measures)


def ranking_metrics(rows: DataFrame, score: str, k: int = 5, *keys: str) -> DataFrame:
    """Mean precision@k over days and capture@k over days with opportunities; unknown scores rank last."""
    day = (*keys, "date")
    order = Window.partitionBy(*day).orderBy(F.desc_nulls_last(score), "ticker")
    chance = F.col("label") != NONE
    ranked = rows.filter(F.col("label").isNotNull()).withColumn("nth", F.row_number().over(order))
    days = ranked.groupBy(*day).agg(
        F.count_if(chance & (F.col("nth") <= k)).alias("hits"),
        F.count_if(chance).alias("n_opps"),
        F.count(F.lit(1)).alias("n"),
    )
    return days.groupBy(*keys).agg(
        F.avg(F.col("hits") / F.least(F.lit(k), F.col("n"))).alias(f"p_at_{k}"),
        F.avg(F.when(F.col("n_opps") > 0, F.col("hits") / F.least("n_opps", F.lit(k)))).alias(f"capture_at_{k}"),
    )


def baseline_scores(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The simple rankers a model must beat: size of the gap, pre-market volume ratio, a seeded hash as chance."""
    key = F.concat_ws("|", "ticker", F.col("date").cast("string"), F.lit(str(seed)))
    chance = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(16**8)
    return rows.withColumns(
        {"baseline_gap": F.abs("gap"), "baseline_pm_vol": F.col("pm_vol_ratio"), "baseline_random": chance}
    )


RANKERS = {
    "model": "opportunity_score",
    "gap": "baseline_gap",
    "pm_vol": "baseline_pm_vol",
    "random": "baseline_random",
}


def compare_rankers(rows: DataFrame, k: int = 5, *keys: str) -> DataFrame:
    """Ranking metrics of every ranker on the same rows: scores are unpivoted, then ranked in one pass."""
    scored = baseline_scores(rows)
    names = F.array(*[F.struct(F.lit(n).alias("ranker"), F.col(c).cast("double").alias("rank_score")) for n, c in RANKERS.items()])
    long = scored.select(*keys, "ticker", "date", "label", F.inline(names))
    return ranking_metrics(long, "rank_score", k, *keys, "ranker")


def precision_score(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    called = F.col(prediction) == 1
    return rows.agg(
        F.try_divide(F.count_if(called & (F.col(truth) == 1)), F.count_if(called)).alias("precision"),
        F.count_if(called).alias("n_called"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def across_folds(per_fold: DataFrame, *metrics: str) -> DataFrame:
    """Mean and sample deviation of each metric over folds (0 for a single fold); unknown values are left out."""
    doubles = per_fold.select("fold_id", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = doubles.unpivot(["fold_id"], list(metrics), "metric", "value")
    known = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy("metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"),
        F.count(F.lit(1)).alias("n_folds"),
    )
