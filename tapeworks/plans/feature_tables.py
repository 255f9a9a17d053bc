"""The two model tables: one row per bar, and one row per (ticker, session)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.rolling import SESSION
from ..operators.intraday import PRICE_FEATURES, TARGET, build_price_features
from ..operators.news import BAR_NEWS, SNAPSHOT_NEWS, bar_news, session_news, unknown_news, with_session_news
from ..operators.premarket import SNAPSHOT_FEATURES, build_snapshot_features

BAR_FEATURES = PRICE_FEATURES + BAR_NEWS
SESSION_FEATURES = SNAPSHOT_FEATURES + SNAPSHOT_NEWS


def bar_feature_table(rth: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """17 price and 9 news features plus the forward return for every regular-session bar."""
    rows = build_price_features(rth)
    rows = unknown_news(rows, BAR_NEWS) if tagged is None else bar_news(rows, tagged)
    return rows.select(*SESSION, "minute", *BAR_FEATURES, TARGET)


def session_feature_table(bars: DataFrame, calendar: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """15 price and 14 news features for every (ticker, session) with regular bars."""
    rows = build_snapshot_features(bars, calendar)
    if tagged is None:
        return unknown_news(rows, SNAPSHOT_NEWS)
    return with_session_news(rows, session_news(tagged, calendar))
