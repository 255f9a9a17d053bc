"""As-of joins, day-block intervals, feature drift, the trip monitor, deflated Sharpe ratios, published articles."""

from __future__ import annotations

import math
import uuid
from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from tapeworks.operators.asof_join import asof_join
from tapeworks.operators.drift import FLOOR, feature_drift
from tapeworks.operators.folds import tag_folds
from tapeworks.operators.monitor import cooled_down, crossings, strongest
from tapeworks.operators.resampling import bootstrap_means, poisson_steps
from tapeworks.operators.selection import deflated_sharpe
from tapeworks.plans.feature_tables import bar_feature_table
from tapeworks.runtime import checkpoint_dir
from tapeworks.sources.ledger import Ledger

from .fixtures import Fixture
from .labels import fixture_folds
from .registry import day, q6, q6s, query, r6, rounded, view
from .trading import fixture_trades

KEY = "ticker, CAST(d AS VARCHAR) AS date, CAST(m AS INT) AS minute"
CLOCK = "date_diff('day', DATE '2024-01-01', d) * 1440 + m"


def clocked(rows: DataFrame) -> DataFrame:
    """Minutes of exchange time since the start of the year."""
    return rows.withColumn("t", (F.datediff("date", F.lit("2024-01-01")) * 1440 + F.col("minute")).cast("long"))


# ---- as-of join -------------------------------------------------------------------------------------------------


def bar_headlines(fx: Fixture, within: int | None = None, strict: bool = False) -> DataFrame:
    minute = F.expr("CAST(unix_micros(from_utc_timestamp(available_ts, 'America/New_York')) div 60000000 - 28401120 AS BIGINT)")
    news = fx.articles.select("ticker", "article_id", minute.alias("known_at"))
    return asof_join(clocked(fx.bars.select("ticker", "date", "minute")), news, ("ticker",), "t", "known_at", ("article_id",), 24 * 60, within, strict)


@view("headline_times", "fx_news")
def _headline_times():
    return "SELECT ticker, avail_min AS known_at, max(article_id) AS article_id FROM fx_news GROUP BY ticker, avail_min"


@query(
    "asof_join",
    "fx_bars",
    "headline_times",
    sql=f"""SELECT b.ticker, CAST(b.d AS VARCHAR) AS date, CAST(b.m AS INT) AS minute, n.known_at, n.article_id
FROM (SELECT *, {CLOCK} AS t FROM fx_bars) b ASOF LEFT JOIN headline_times n ON b.ticker = n.ticker AND b.t >= n.known_at""",
)
def _(fx):
    return bar_headlines(fx).select("ticker", day(), "minute", "known_at", "article_id")


@query(
    "asof_join_within",
    "fx_bars",
    "headline_times",
    sql=f"""SELECT b.ticker, CAST(b.d AS VARCHAR) AS date, CAST(b.m AS INT) AS minute, CASE WHEN b.t - n.known_at <= 90 THEN n.known_at END AS known_at,
  CASE WHEN b.t - n.known_at <= 90 THEN n.article_id END AS article_id
FROM (SELECT *, {CLOCK} AS t FROM fx_bars) b ASOF LEFT JOIN headline_times n ON b.ticker = n.ticker AND b.t > n.known_at""",
)
def _(fx):
    return bar_headlines(fx, 90, True).select("ticker", day(), "minute", "known_at", "article_id")


# ---- day-block intervals ---------------------------------------------------------------------------------------------

REPLICATES, SEED = 400, 7


@view("trade_day_sums", "thinned")
def _trade_day_sums():
    return "SELECT ticker, d, sum(net_ret) AS s, count(*) AS n FROM thinned GROUP BY ticker, d"


@view("resampled", "trade_day_sums")
def _resampled():
    weight = " + ".join(f"CAST(draw >= {step} AS INT)" for step in poisson_steps())
    draws = f"""SELECT t.*, r.range AS replicate, CAST('0x' || substr(md5('{SEED}:' || r.range || ':' || CAST(d AS VARCHAR)), 1, 8) AS BIGINT) AS draw
FROM trade_day_sums t, range(1, {REPLICATES + 1}) r"""
    return f"""SELECT ticker, replicate, sum(w * s) / sum(w * n) AS m FROM (SELECT *, {weight} AS w FROM ({draws})) WHERE w > 0
GROUP BY ticker, replicate"""


@query(
    "bootstrap_means",
    "trade_day_sums",
    "resampled",
    sql=f"""SELECT w.ticker, n_days, n_rows, {q6('mean')} AS mean, {q6('low')} AS low, {q6('high')} AS high FROM
  (SELECT ticker, count(*) AS n_days, CAST(sum(n) AS BIGINT) AS n_rows, sum(s) / sum(n) AS mean FROM trade_day_sums GROUP BY ticker) w JOIN
  (SELECT ticker, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM resampled GROUP BY ticker) r ON w.ticker = r.ticker""",
)
def _(fx):
    got = bootstrap_means(fixture_trades(fx), "net_ret", ("ticker",), REPLICATES, 0.95, SEED)
    return got.select("ticker", "n_days", "n_rows", *rounded("mean", "low", "high"))


# ---- feature drift ----------------------------------------------------------------------------------------------------

DRIFTING = ("r15", "vol_ratio", "vwap_dist", "rv30")


@view("drift_rows", "bar_features", "folds")
def _drift_rows():
    each = " UNION ALL ".join(f"SELECT f.fold_id, f.segment, '{c}' AS feature, CAST(b.{c} AS DOUBLE) AS x FROM bar_features b JOIN folds f ON f.d = b.d" for c in DRIFTING)
    return each


@view("drift_bins", "drift_rows")
def _drift_bins():
    marks = ", ".join(f"{i / 10}" for i in range(1, 10))
    edges = f"SELECT fold_id, feature, quantile_disc(x, [{marks}]) AS edges FROM drift_rows WHERE segment = 'train' AND x IS NOT NULL GROUP BY fold_id, feature"
    place = "CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e < x)) END"
    return f"""SELECT fold_id, feature, bin, count(CASE WHEN segment = 'train' THEN 1 END) AS train,
  count(CASE WHEN segment = 'calibrate' THEN 1 END) AS calibrate, count(CASE WHEN segment = 'test' THEN 1 END) AS test
FROM (SELECT r.*, {place} AS bin FROM drift_rows r JOIN ({edges}) e USING (fold_id, feature)) GROUP BY fold_id, feature, bin"""


def _drift_sql() -> str:
    share = lambda s: f"greatest({s} / sum({s}) OVER (PARTITION BY fold_id, feature), {FLOOR})"
    parts = [
        f"""SELECT fold_id, feature, '{s}' AS segment, CAST(sum({s}) AS BIGINT) AS n_rows, {q6('sum((p - q) * ln(p / q))')} AS psi
FROM (SELECT *, {share(s)} AS p, {share('train')} AS q FROM drift_bins) GROUP BY fold_id, feature HAVING sum({s}) > 0"""
        for s in ("calibrate", "test")
    ]
    return " UNION ALL ".join(parts)


@query("feature_drift", "drift_bins", sql=_drift_sql())
def _(fx):
    rows = tag_folds(bar_feature_table(fx.rth).select("date", *DRIFTING), fixture_folds(fx))
    return feature_drift(rows, DRIFTING).select("fold_id", "feature", "segment", "n_rows", r6("psi").alias("psi"))


# ---- trip monitor -------------------------------------------------------------------------------------------------------

ENTER, LEAVE, WAIT, INTERVAL, MOST = 1.5, 1.0, 45, 30, 2


@view("monitor_states", "bar_features")
def _monitor_states():
    return f"""SELECT ticker, d, m, {CLOCK} AS t, vol_ratio, coalesce(last_value(CASE WHEN vol_ratio >= {ENTER} THEN 1 WHEN vol_ratio < {LEAVE} THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY ticker, d ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM bar_features"""


@view("trips", "monitor_states")
def _trips():
    return """SELECT * FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY ticker, d ORDER BY m), 0) AS was FROM monitor_states)
WHERE state = 1 AND was = 0"""


@view("trip_chain", "trips", recursive=True)
def _trip_chain():
    return f"""SELECT ticker, min(t) AS t FROM trips GROUP BY ticker
UNION ALL SELECT c.ticker, (SELECT min(x.t) FROM trips x WHERE x.ticker = c.ticker AND x.t >= c.t + {WAIT}) AS t FROM trip_chain c
WHERE EXISTS (SELECT 1 FROM trips x WHERE x.ticker = c.ticker AND x.t >= c.t + {WAIT})"""


def fixture_trips(fx: Fixture) -> DataFrame:
    rows = clocked(bar_feature_table(fx.rth).select("ticker", "date", "minute", "vol_ratio"))
    return cooled_down(crossings(rows, "vol_ratio", ENTER, LEAVE), ("ticker",), "t", WAIT)


@query(
    "cooled_down",
    "trips",
    "trip_chain",
    sql=f"SELECT {KEY}, {q6('vol_ratio')} AS vol_ratio FROM trips JOIN trip_chain USING (ticker, t)",
)
def _(fx):
    return fixture_trips(fx).select("ticker", day(), "minute", r6("vol_ratio").alias("vol_ratio"))


@query(
    "strongest_trips",
    "trips",
    "trip_chain",
    sql=f"""SELECT {KEY} FROM (SELECT *, row_number() OVER (PARTITION BY t // {INTERVAL} ORDER BY vol_ratio DESC, ticker, t) AS nth
FROM trips JOIN trip_chain USING (ticker, t)) WHERE nth <= {MOST}""",
)
def _(fx):
    return strongest(fixture_trips(fx), "t", INTERVAL, "vol_ratio", MOST).select("ticker", day(), "minute")


# ---- deflated Sharpe ratio ------------------------------------------------------------------------------------------------


@view("trial_moments", "trade_day_sums")
def _trial_moments():
    sums = "SELECT ticker, count(*) AS n, " + ", ".join(f"sum(s ** {k}) / count(*) AS r{k}" for k in (1, 2, 3, 4)) + " FROM trade_day_sums GROUP BY ticker"
    second = "(r2 - r1 ** 2)"
    return f"""SELECT ticker, n, r1 / sqrt({second} * n / (n - 1)) AS sharpe, (r3 - 3 * r1 * r2 + 2 * r1 ** 3) / {second} ** 1.5 AS skew,
  (r4 - 4 * r1 * r3 + 6 * r1 ** 2 * r2 - 3 * r1 ** 4) / {second} ** 2 AS kurtosis FROM ({sums}) WHERE n > 1 AND {second} > 0"""


def _chance(n: int) -> float:
    """Expected best of n draws of a standard normal, to the order that the deflated ratio uses."""
    inverse, gamma = NormalDist().inv_cdf, 0.5772156649015329
    return (1 - gamma) * inverse(1 - 1 / n) + gamma * inverse(1 - 1 / (n * math.e))


def _deflated_sql() -> str:
    lucky = "CASE n_trials " + " ".join(f"WHEN {n} THEN {_chance(n)!r}" for n in range(2, 9)) + " END * spread"
    odd, terms = 1.0, []
    for k in range(90):
        odd *= 2 * k + 1
        terms.append(f"z ** {2 * k + 1} / {odd!r}")
    cdf = f"0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * ({' + '.join(terms)})"
    return f"""SELECT ticker, n, n_trials, {q6s('sharpe', 'skew', 'kurtosis', 'lucky_sharpe')}, {q6(cdf)} AS deflated FROM (SELECT *,
  (sharpe - lucky_sharpe) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe ** 2) AS z FROM (SELECT *, {lucky} AS lucky_sharpe FROM
  (SELECT *, count(*) OVER () AS n_trials, stddev_samp(sharpe) OVER () AS spread FROM trial_moments)))"""


@query("deflated_sharpe", "trial_moments", sql=_deflated_sql())
def _(fx):
    days = fixture_trades(fx).groupBy("ticker", "date").agg(F.sum("net_ret").alias("ret"))
    return deflated_sharpe(days, "ret", "ticker").select("ticker", "n", "n_trials", *rounded("sharpe", "skew", "kurtosis", "lucky_sharpe", "deflated"))


# ---- published articles ---------------------------------------------------------------------------------------------------


@query(
    "published_articles",
    "fx_news",
    sql="SELECT article_id, publisher, CASE WHEN article_id % 2 = 0 THEN 1 ELSE 2 END AS batch FROM fx_news WHERE article_id % 2 = 0 OR article_id % 3 = 0",
)
def _(fx):
    ledger = Ledger(fx.spark, f"{checkpoint_dir(fx.spark)}/published-{uuid.uuid4().hex}", buckets=8)
    rows = fx.articles.select("article_id", "publisher")
    ledger.publish(rows.filter("article_id % 2 = 0").withColumn("batch", F.lit(1)))
    ledger.publish(rows.filter("article_id % 3 = 0").withColumn("batch", F.lit(2)))  # a third of them again
    return ledger.rows()
