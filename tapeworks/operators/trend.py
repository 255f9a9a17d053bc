"""Long-horizon ratio and trend features of a daily series, and its next-day target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rolling import day_order, running

HORIZONS = (2, 5, 60, 250, 1000)


def next_day_target(daily: DataFrame) -> DataFrame:
    """tomorrow = next close; target = 1 when it is higher (0 on the last row, which has no tomorrow)."""
    tomorrow = F.lead("close", 1).over(day_order())
    return daily.withColumns(
        {"tomorrow": tomorrow, "target": F.coalesce((tomorrow > F.col("close")).cast("int"), F.lit(0))}
    )


def trend_features(daily: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """close_ratio_h = close / mean close of the last h rows (today included); trend_h = sum of ``target`` over the
    h rows before today. NULL until the window is full.

    Moving sums come from differences of running sums, so a row costs the same for any horizon.
    """
    order = day_order()
    upto = running(order)
    sums = daily.withColumns(
        {
            "_close": F.sum("close").over(upto),
            "_known": F.count("close").over(upto),
            "_target": F.sum("target").over(upto),
            "_rows": F.row_number().over(order),
        }
    )
    features = {}
    for h in horizons:
        def moved(column: str, back: int, h: int = h):
            now = F.lag(column, back, 0).over(order) if back else F.col(column)
            return now - F.lag(column, back + h, 0).over(order)

        full = moved("_known", 0) == h
        features[f"close_ratio_{h}"] = F.when(full, F.col("close") * h / moved("_close", 0))
        features[f"trend_{h}"] = F.when(F.col("_rows") > h, moved("_target", 1).cast("double"))
    return sums.withColumns(features).drop("_close", "_known", "_target", "_rows")


def trend_columns(horizons: tuple[int, ...] = HORIZONS) -> list[str]:
    return [f"{kind}_{h}" for h in horizons for kind in ("close_ratio", "trend")]
