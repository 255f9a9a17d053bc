"""Feature drift: how far the distribution of each feature has moved from the training segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .folds import CALIBRATE, TEST, TRAIN

FLOOR = 1e-4  # share of an empty bin
ACCURACY = 10_000


def feature_drift(tagged: DataFrame, features: tuple[str, ...], bins: int = 10) -> DataFrame:
    """Population stability index of each (fold_id, feature, segment) against the fold's training segment.

    ``tagged`` has fold_id, segment and the features. Bin edges are quantiles of the training segment, from sketches that merge; a
    null is a bin of its own, beside those between the edges. All folds, segments and features are counted in one pass; the
    table of edges has one row for each fold and feature. Segments without rows, and features without a known training value, give none.
    """
    long = tagged.select("fold_id", "segment", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    marks = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = long.filter((F.col("segment") == TRAIN) & F.col("x").isNotNull()).groupBy("fold_id", "feature").agg(F.percentile_approx("x", marks, ACCURACY).alias("edges"))
    placed = long.join(edges, ["fold_id", "feature"]).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("x"))))
    placed = placed.withColumn("bin", F.when(F.col("x").isNull(), -1).otherwise(F.col("bin")))
    segments = (TRAIN, CALIBRATE, TEST)
    counted = placed.groupBy("fold_id", "feature", "bin").agg(*[F.count_if(F.col("segment") == s).alias(s) for s in segments])
    whole = counted.groupBy("fold_id", "feature").agg(*[F.sum(s).alias(f"n_{s}") for s in segments])
    shares = {s: F.greatest(F.try_divide(F.col(s), F.col(f"n_{s}")), F.lit(FLOOR)) for s in segments}
    terms = [F.struct(F.lit(s).alias("segment"), ((shares[s] - shares[TRAIN]) * F.ln(shares[s] / shares[TRAIN])).alias("term"), F.col(f"n_{s}").alias("n")) for s in segments[1:]]
    each = counted.join(whole, ["fold_id", "feature"]).select("fold_id", "feature", F.inline(F.array(*terms)))
    return each.filter("n > 0").groupBy("fold_id", "feature", "segment").agg(F.first("n").alias("n_rows"), F.sum("term").alias("psi"))
