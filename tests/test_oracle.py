"""Registered queries against their oracle SQL on the smallest tables.

A cross-section keeps the suite short; ``python tests/check_queries.py 0.01`` compares every query.
"""

import os

import pytest

from catalog import ORACLES, QUERIES
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
CROSS_SECTION = (
    "session_calendar", "session_bars_asof", "read_news_pages", "build_windows", "fold_labels", "label_stability", "price_features",
    "snapshot_features", "trend_features", "cluster_articles", "bar_news", "snapshot_news", "run_breakout", "strategy_sweep",
    "thin_events", "breakout_replay", "compare_rankers", "slice_trades", "asof_join_within", "bootstrap_means", "feature_drift", "strongest_trips",
    "deflated_sharpe", "published_articles", "backtest_record", "backtest_curve", "news_gated_arm", "written_trades",
)
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="generated tables are not mounted")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@needs_tables
@pytest.mark.parametrize("name", CROSS_SECTION)
def test_query_matches_its_oracle(spark, con, name):
    assert differences(con, QUERIES[name](spark, FOLDER), ORACLES[name]) == []


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@needs_tables
def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
