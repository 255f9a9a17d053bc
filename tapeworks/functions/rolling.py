"""Window-frame helpers with pandas-style minimum observation counts."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

SESSION = ("ticker", "date")


def session_order() -> WindowSpec:
    return Window.partitionBy(*SESSION).orderBy("minute")


def whole_session() -> WindowSpec:
    return Window.partitionBy(*SESSION)


def day_order(*extra: str) -> WindowSpec:
    """One row per trading day: a ticker's history, bounded by the calendar."""
    return Window.partitionBy("ticker", *extra).orderBy("date")


def guarded(aggregate: Column, counted: Column, frame: WindowSpec, least: int) -> Column:
    """``aggregate`` over the frame, NULL until it holds ``least`` known values."""
    return F.when(F.count(counted).over(frame) >= least, aggregate.over(frame))


def rolling_std(value: Column, frame: WindowSpec, least: int) -> Column:
    return guarded(F.stddev_samp(value), value, frame, least)


def _middle(values: Column) -> Column:
    """Median of an array of doubles, NULL when it is empty; the array is sorted once."""

    def pick(v: Column) -> Column:
        low, high = F.floor((F.size(v) - 1) / 2), F.floor(F.size(v) / 2)
        return (F.get(v, low.cast("int")) + F.get(v, high.cast("int"))) / 2

    return F.get(F.transform(F.array(F.sort_array(values)), pick), F.lit(0))


def rolling_median(value: Column, frame: WindowSpec, least: int) -> Column:
    """Median over a short frame (a session or some days). Sorting its primitive values beats the percentile
    aggregate's hash map by far, since a window evaluates it on every row."""
    return F.when(F.count(value).over(frame) >= least, _middle(F.collect_list(value).over(frame)))


def rolling_mean(value: Column, frame: WindowSpec, least: int) -> Column:
    return guarded(F.avg(value), value, frame, least)


def running(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, -1)
