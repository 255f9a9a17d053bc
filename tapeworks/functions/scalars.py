"""Null-aware arithmetic. Unknown is NULL: never zero-filled, and it never satisfies a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column; Spark would otherwise rank NaN above all numbers."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def ratio(top, bottom) -> Column:
    """top / bottom, NULL where the bottom is zero or unknown."""
    return F.try_divide(as_col(top), as_col(bottom))


def log_ratio(top, bottom) -> Column:
    """ln(top / bottom), NULL outside the logarithm's domain."""
    return F.ln(ratio(top, bottom))


def holds(condition: Column) -> Column:
    """A gate: unknown counts as not met."""
    return F.coalesce(condition, F.lit(False))


def share(condition: Column) -> Column:
    """Fraction of rows meeting a condition (aggregate)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def price_ref() -> Column:
    """Price that values a bar's volume: its VWAP, or the close when no VWAP is known."""
    return F.coalesce(F.col("vwap"), F.col("close"))


def linear_score(p_opening: str = "p_opening_only", p_sustained: str = "p_sustained") -> Column:
    # Opportunity weights of the two active classes.
    return 0.40 * F.col(p_opening) + 1.00 * F.col(p_sustained)


def log_probability(p: Column, floor: float = 1e-9) -> Column:
    return F.ln(F.least(F.greatest(p, F.lit(floor)), F.lit(1.0)))


def argmax_index(*columns: str) -> Column:
    """Zero-based position of the largest value, the first one on ties."""
    packed = F.array(*[F.col(c) for c in columns])
    return (F.array_position(packed, F.array_max(packed)) - 1).cast("int")


def sorted_quantiles(*columns: str) -> list[Column]:
    """The row's forecasts in ascending order, so quantiles never cross."""
    ordered = F.array_sort(F.array(*[F.col(c) for c in columns]))
    return [ordered[i].alias(c) for i, c in enumerate(columns)]


def threshold_flag(p: Column, floor: float = 0.6) -> Column:
    return F.when(p >= floor, 1).otherwise(0)
