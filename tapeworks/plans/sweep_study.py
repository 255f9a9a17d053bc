"""The sweep strategy over a grid of target settings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import SweepConfig
from ..operators.asof import daily_bars
from ..operators.sweep import STOCK_COST, compound_r, sweep_trades
from ..operators.sweep_stats import strategy_stats

# Target settings, and the one-way cost per unit of a currency pair (a stock's is STOCK_COST).
SETTINGS = (*(SweepConfig(rr=r) for r in (1.0, 1.5, 2.0, 3.0)), SweepConfig(target_mode="liquidity"))
PAIR_COST = 0.00005


def grid_trades(
    bars: DataFrame, settings: tuple[SweepConfig, ...] = SETTINGS, costs: DataFrame | float = STOCK_COST
) -> DataFrame:
    """Trades of every setting: sweeps are found once, then each setting prices, fills and closes them.

    ``costs`` is one cost per unit, or a table (ticker, unit_cost) of markets that differ from stocks.
    """
    return compound_r(sweep_trades(bars, daily_bars(bars), settings, costs))


def strategy_sweep(bars: DataFrame, settings: tuple[SweepConfig, ...] = SETTINGS, costs: DataFrame | float = STOCK_COST) -> DataFrame:
    return strategy_stats(grid_trades(bars, settings, costs))
