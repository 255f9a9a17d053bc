"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

from . import views  # noqa: F401  (the views come first)
from . import labels, features, news, signals, tables, trading, models, research, backtests  # noqa: F401  (registration)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
