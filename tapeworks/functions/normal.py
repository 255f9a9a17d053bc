"""The normal distribution as column expressions, from quadrature instead of fitted constants."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

NODES, STEPS, FAR = 48, 40, 8.5


def _quadrature() -> Column:
    """Gauss-Legendre nodes and weights on [0, 1]."""
    at, weight = np.polynomial.legendre.leggauss(NODES)
    return F.array(*[F.struct(F.lit(float((t + 1) / 2)).alias("t"), F.lit(float(w / 2)).alias("w")) for t, w in zip(at, weight)])


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """P(Z <= x), to about 14 decimals; beyond ``FAR`` it is that of ``FAR``."""
    near = F.greatest(F.least(x, F.lit(FAR)), F.lit(-FAR))
    area = F.aggregate(_quadrature(), F.lit(0.0), lambda s, n: s + n["w"] * F.exp(-near * near * n["t"] * n["t"] / 2))
    return F.when(x.isNotNull(), 0.5 + near * area / math.sqrt(2 * math.pi))


def normal_quantile(p: Column) -> Column:
    """The x with P(Z <= x) = p for 0 < p < 1, NULL otherwise.

    Newton steps on the upper half from a bound above the root. The distribution function is concave there, so after the
    first step all come from below.
    """
    upper = F.greatest(p, 1 - p)
    start = F.sqrt(-2 * F.ln(F.least(2 * (1 - upper), F.lit(1.0))))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda x, _: x - (normal_cdf(x) - upper) / normal_pdf(x))
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -root).otherwise(root))
