"""Pages to tables, as-of reads, coverage, the calendar, appends and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeworks.operators import asof
from tapeworks.operators.folds import fold_bounds
from tapeworks.plans.feature_tables import session_feature_table
from tapeworks.plans.records import experiment_record
from tapeworks.sources import calendar as cal
from tapeworks.sources import pages, tables

from .fixtures import LAYOUT, Fixture
from .labels import fixture_folds, fixture_stability
from .registry import day, q6, q6s, query, r6, rounded, view

KEY = "ticker, CAST(d AS VARCHAR) AS date, CAST(m AS INT) AS minute"
PRICES = ("open", "high", "low", "close", "volume", "vwap")
AS_OF_DAY, AS_OF_MINUTE = "2024-01-20", 720


def local_minutes(column: str, alias: str):
    """Minutes of exchange time since 2024-01-01 (January has no clock change)."""
    return F.expr(
        f"CAST(unix_micros(from_utc_timestamp({column}, 'America/New_York')) div 60000000 - 28401120 AS BIGINT)"
    ).alias(alias)


def local_seconds(column: str, alias: str):
    return F.expr(
        f"CAST(unix_micros(from_utc_timestamp({column}, 'America/New_York')) div 1000000 - 1704067200 AS BIGINT)"
    ).alias(alias)


MINUTES = "date_diff('day', DATE '2024-01-01', d) * 1440 + m"


# ---- landed pages: rebuild the vendor JSON from the tables, then read it back ---------------------------------


def bar_payloads(fx: Fixture) -> DataFrame:
    """One page per ticker-day (at most 192 bars)."""
    item = F.struct(
        F.unix_millis("event_ts").alias("t"),
        F.col("open").alias("o"),
        F.col("high").alias("h"),
        F.col("low").alias("l"),
        F.col("close").alias("c"),
        F.col("volume").alias("v"),
        F.col("trade_count").alias("n"),
        F.col("vwap").alias("vw"),
    )
    page = fx.bars.groupBy("ticker", "date").agg(F.collect_list(item).alias("results"))
    return page.select(F.to_json(F.struct("ticker", "results")).alias("payload"))


@query(
    "read_bar_pages",
    "fx_bars",
    sql=f"SELECT ticker, {MINUTES} AS start_min, ({MINUTES}) * 60 + 305 AS available_s, trade_count, {q6s(*PRICES)} FROM fx_bars",
)
def _(fx):
    bars = pages.bars_from_pages(pages.parse_payloads(bar_payloads(fx), pages.BAR_PAGE))
    return bars.select(
        "ticker", local_minutes("event_ts", "start_min"), local_seconds("available_ts", "available_s"), "trade_count", *rounded(*PRICES)
    )


def news_payloads(fx: Fixture) -> DataFrame:
    """One page per article: two tags, an insight for the first only where a sentiment is known."""
    other = F.concat(F.lit("N"), (F.col("article_id") % 5).cast("string"))
    given = F.array(
        F.struct(F.col("ticker").alias("ticker"), F.lit("neutral").alias("sentiment"), F.lit("early").alias("sentiment_reasoning")),
        F.struct(F.col("ticker").alias("ticker"), F.col("sentiment"), F.lit("late").alias("sentiment_reasoning")),
    )
    item = F.struct(
        F.col("article_id").cast("string").alias("id"),
        F.date_format("published_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_utc"),
        F.struct(F.col("publisher").alias("name")).alias("publisher"),
        "title",
        "description",
        F.array("ticker", other).alias("tickers"),
        F.when(F.col("sentiment").isNotNull(), given).alias("insights"),
    )
    return fx.articles.select(F.to_json(F.struct(F.array(item).alias("results"))).alias("payload"))


def parsed_articles(fx: Fixture) -> DataFrame:
    return pages.articles_from_pages(pages.parse_payloads(news_payloads(fx), pages.NEWS_PAGE))


@query(
    "read_news_pages",
    "fx_news",
    sql="SELECT CAST(article_id AS VARCHAR) AS article_id, pub_min AS published_min, avail_min AS available_min, publisher, title, description,"
    " CAST(0 AS INT) AS n_keywords, CAST(2 AS INT) AS n_tags FROM fx_news",
)
def _(fx):
    return parsed_articles(fx).select(
        "article_id",
        local_minutes("published_ts", "published_min"),
        local_minutes("available_ts", "available_min"),
        "publisher",
        "title",
        "description",
        F.size("keywords").alias("n_keywords"),
        F.size("tickers").alias("n_tags"),
    )


@query(
    "article_tags",
    "fx_news",
    sql="""SELECT CAST(article_id AS VARCHAR) AS article_id, ticker, sentiment,
  CASE WHEN sentiment IS NOT NULL THEN 'late' END AS sentiment_reasoning FROM fx_news
UNION ALL SELECT CAST(article_id AS VARCHAR), concat('N', CAST(article_id % 5 AS VARCHAR)), NULL, NULL FROM fx_news""",
)
def _(fx):
    return pages.article_tags(parsed_articles(fx))


# ---- appends --------------------------------------------------------------------------------------------------


@query(
    "new_bars",
    "fx_revised",
    sql=f"SELECT ticker, {MINUTES} AS start_min, {q6('close')} AS close FROM fx_revised WHERE late > 0",
)
def _(fx):
    # The stored table holds first versions; the batch repeats all of them and brings the corrections.
    batch = fx.revised_bars.unionByName(fx.bars)
    return tables.new_bars(fx.bars, batch).select("ticker", local_minutes("event_ts", "start_min"), *rounded("close"))


@query(
    "new_articles",
    "fx_news",
    sql="SELECT article_id, publisher FROM fx_news WHERE article_id NOT IN (SELECT doc_id FROM labels)",
)
def _(fx):
    stored = fx.articles.join(fx.table("labels").select(F.col("doc_id").alias("article_id")), "article_id", "left_semi")
    return tables.new_articles(stored, fx.articles.unionByName(fx.articles)).select("article_id", "publisher")


# ---- as-of reads ----------------------------------------------------------------------------------------------


def visible_sql(moment: str, extra: str = "") -> str:
    return f"""SELECT ticker, d, m, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker, d, m ORDER BY late DESC) AS nth
FROM fx_revised r WHERE ({MINUTES}) * 60 + 305 + late * 60 <= ({moment}) * 60 {extra}) WHERE nth = 1"""


AS_OF = f"date_diff('day', DATE '2024-01-01', DATE '{AS_OF_DAY}') * 1440 + {AS_OF_MINUTE}"


def as_of_instant():
    from tapeworks.functions.clock import exchange_instant

    return exchange_instant(F.lit(AS_OF_DAY).cast("date"), F.lit(AS_OF_MINUTE))


@query("bars_asof", "fx_revised", sql=f"SELECT {KEY}, {q6s('close', 'volume')} FROM ({visible_sql(AS_OF)})")
def _(fx):
    return asof.bars_asof(fx.revised_bars, as_of_instant()).select("ticker", day(), "minute", *rounded("close", "volume"))


@query(
    "bars_asof_lookback",
    "fx_revised",
    sql=f"SELECT {KEY}, {q6s('close', 'volume')} FROM ({visible_sql(AS_OF, f'AND {MINUTES} >= {AS_OF} - 2880')})",
)
def _(fx):
    read = asof.bars_asof(fx.revised_bars, as_of_instant(), 2880)
    return read.select("ticker", day(), "minute", *rounded("close", "volume"))


@view("session_visible", "fx_revised", "fx_cal")
def _session_visible():
    return f"""SELECT ticker, d, m, close, volume FROM (SELECT r.*, row_number() OVER (PARTITION BY r.ticker, r.d, r.m ORDER BY late DESC) AS nth
FROM fx_revised r JOIN fx_cal c ON c.d = r.d WHERE r.m >= c.open_min AND r.m < c.close_min
  AND r.m * 60 + 305 + late * 60 <= (c.close_min + 30) * 60) WHERE nth = 1"""


@query("session_bars_asof", "session_visible", sql=f"SELECT {KEY}, {q6s('close', 'volume')} FROM session_visible")
def _(fx):
    read = asof.session_bars_asof(fx.revised_bars, fx.calendar)
    return read.select("ticker", day(), "minute", *rounded("close", "volume"))


@query(
    "range_bars_asof",
    "fx_revised",
    sql=f"""SELECT {KEY}, {q6s('close')} FROM ({visible_sql("date_diff('day', DATE '2024-01-01', DATE '2024-01-31') * 1440 + 990",
        "AND d >= DATE '2024-01-02' AND NOT (d = DATE '2024-01-02' AND m < 210)")})""",
)
def _(fx):
    read = asof.range_bars_asof(fx.revised_bars, fx.calendar, "2024-01-02", "2024-01-31", regular_only=False)
    return read.select("ticker", day(), "minute", *rounded("close"))


@query(
    "latest_bars",
    "fx_bars",
    sql=f"SELECT {KEY}, {q6('CASE WHEN m % 60 = 0 THEN close + 1 ELSE close END')} AS close FROM fx_bars",
)
def _(fx):
    return asof.latest_bars(fx.revised_bars).select("ticker", day(), "minute", *rounded("close"))


@query(
    "news_asof",
    "fx_news",
    sql=f"SELECT article_id, ticker, sentiment, pub_min FROM fx_news WHERE avail_min <= {AS_OF}",
)
def _(fx):
    articles = fx.articles.drop("ticker", "sentiment")
    read = asof.news_asof(articles, fx.tags, as_of_instant())
    return read.select("article_id", "ticker", "sentiment", local_minutes("published_ts", "pub_min"))


@query("rth_bars", "fx_rth", sql=f"SELECT {KEY}, open_min, close_min, {q6s('close')} FROM fx_rth")
def _(fx):
    return asof.rth_bars(fx.bars, fx.calendar).select("ticker", day(), "minute", "open_min", "close_min", *rounded("close"))


@query(
    "daily_bars",
    "all_days",
    sql=f"SELECT ticker, CAST(d AS VARCHAR) AS date, {q6s('open', 'high', 'low', 'close', 'volume')} FROM all_days",
)
def _(fx):
    return asof.daily_bars(fx.bars).select("ticker", day(), *rounded("open", "high", "low", "close", "volume"))


@query(
    "bar_coverage",
    "fx_bars",
    sql=f"SELECT ticker, count(*) AS n_rows, min({MINUTES}) AS first_min, max({MINUTES}) AS last_min FROM fx_bars GROUP BY ticker",
)
def _(fx):
    read = asof.bar_coverage(fx.bars)
    return read.select("ticker", "n_rows", local_minutes("first_ts", "first_min"), local_minutes("last_ts", "last_min"))


@query(
    "news_coverage",
    "fx_news",
    sql="SELECT count(*) AS n_articles, min(pub_min) AS first_min, max(pub_min) AS last_min FROM fx_news",
)
def _(fx):
    read = asof.news_coverage(fx.articles)
    return read.select("n_articles", local_minutes("first_ts", "first_min"), local_minutes("last_ts", "last_min"))


@query(
    "stored_session_index",
    "fx_rth",
    sql="SELECT ticker, CAST(d AS VARCHAR) AS date, CAST(dense_rank() OVER (PARTITION BY ticker ORDER BY d) - 1 AS INT) AS stored_idx"
    " FROM (SELECT DISTINCT ticker, d FROM fx_rth)",
)
def _(fx):
    return asof.stored_session_index(asof.distinct_sessions(fx.rth)).select("ticker", day(), "stored_idx")


@query(
    "prior_session_bars",
    "fx_rth",
    "folds",
    sql="""SELECT ticker, CAST(d AS VARCHAR) AS date, count(*) AS n_bars FROM fx_rth b WHERE EXISTS (
  SELECT 1 FROM (SELECT ticker, d, lead(d) OVER (PARTITION BY ticker ORDER BY d) AS next_d FROM (SELECT DISTINCT ticker, d FROM fx_rth)) s
  WHERE s.ticker = b.ticker AND s.d = b.d AND (s.d IN (SELECT d FROM folds WHERE segment = 'test')
    OR s.next_d IN (SELECT d FROM folds WHERE segment = 'test'))) GROUP BY ticker, d""",
)
def _(fx):
    test = fixture_folds(fx).filter(F.col("segment") == "test")
    kept = asof.with_prior_sessions(fx.rth, test)
    return kept.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n_bars")).select("ticker", day(), "n_bars")


# ---- calendar over the orders' dates, moved 22 years on so that holidays, half days and clock changes occur ---

SHIFT_DAYS = 8036


@view("order_days")
def _order_days():
    return f"""SELECT CAST(o_orderdate AS DATE) + {SHIFT_DAYS} AS d, count(*) AS n_orders FROM orders GROUP BY 1"""


@view("nyse", "order_days")
def _nyse():
    """Sessions spelled out as predicates; Good Fridays are listed."""
    good_fridays = ", ".join(
        f"DATE '{d}'"
        for d in ("2017-04-14", "2018-03-30", "2019-04-19", "2020-04-10", "2021-04-02", "2022-04-15", "2023-04-07", "2024-03-29")
    )

    def fixed(month: int, dd: int) -> str:
        return (
            f"(month(d) = {month} AND ((day(d) = {dd} AND isodow(d) <= 5) OR (day(d) = {dd - 1} AND isodow(d) = 5)"
            f" OR (day(d) = {dd + 1} AND isodow(d) = 1)))"
        )

    closed = f"""(month(d) = 1 AND ((day(d) = 1 AND isodow(d) <= 5) OR (day(d) = 2 AND isodow(d) = 1)))
  OR (month(d) IN (1, 2) AND isodow(d) = 1 AND day(d) BETWEEN 15 AND 21) OR d IN ({good_fridays})
  OR (month(d) = 5 AND isodow(d) = 1 AND day(d) >= 25) OR (year(d) >= 2022 AND {fixed(6, 19)}) OR {fixed(7, 4)}
  OR (month(d) = 9 AND isodow(d) = 1 AND day(d) <= 7) OR (month(d) = 11 AND isodow(d) = 4 AND day(d) BETWEEN 22 AND 28)
  OR {fixed(12, 25)} OR d = DATE '2018-12-05'"""
    early = """(month(d) = 7 AND day(d) = 3 AND isodow(d) < 5) OR (month(d) = 11 AND isodow(d) = 5 AND day(d) BETWEEN 23 AND 29)
  OR (month(d) = 12 AND day(d) = 24 AND isodow(d) < 5)"""
    summer = """d >= (SELECT max(x) FROM (SELECT unnest(generate_series(make_date(year(d), 3, 8), make_date(year(d), 3, 14), INTERVAL 1 DAY)) AS x) WHERE isodow(x) = 7)
   AND d < (SELECT max(x) FROM (SELECT unnest(generate_series(make_date(year(d), 11, 1), make_date(year(d), 11, 7), INTERVAL 1 DAY)) AS x) WHERE isodow(x) = 7)"""
    return f"""SELECT d, 570 AS open_min, CASE WHEN {early} THEN 780 ELSE 960 END AS close_min, CASE WHEN {summer} THEN 240 ELSE 300 END AS utc_lag
FROM (SELECT CAST(unnest(generate_series((SELECT min(d) FROM order_days), (SELECT max(d) + 14 FROM order_days), INTERVAL 1 DAY)) AS DATE) AS d)
WHERE isodow(d) <= 5 AND NOT coalesce({closed}, false)"""


def order_days(fx: Fixture) -> DataFrame:
    moved = F.date_add(F.col("o_orderdate").cast("date"), SHIFT_DAYS).alias("date")
    return fx.table("orders").groupBy(moved).agg(F.count(F.lit(1)).alias("n_orders"))


def long_calendar(fx: Fixture) -> DataFrame:
    return cal.session_calendar(fx.spark, "2016-12-01", "2024-12-31")


def utc_minute(column: str, alias: str):
    return F.expr(f"CAST(hour({column}) * 60 + minute({column}) AS INT)").alias(alias)


@query(
    "session_calendar",
    "nyse",
    "order_days",
    sql="SELECT CAST(n.d AS VARCHAR) AS date, o.n_orders, n.open_min, CAST(n.close_min AS INT) AS close_min,"
    " CAST(n.open_min + utc_lag AS INT) AS open_utc, CAST(n.close_min + utc_lag AS INT) AS close_utc,"
    " CAST(540 + utc_lag AS INT) AS cutoff_utc FROM nyse n JOIN order_days o ON o.d = n.d",
)
def _(fx):
    joined = order_days(fx).join(F.broadcast(long_calendar(fx)), "date")
    return joined.select(
        day(),
        "n_orders",
        "open_min",
        "close_min",
        utc_minute("open_ts", "open_utc"),
        utc_minute("close_ts", "close_utc"),
        utc_minute("cutoff_ts", "cutoff_utc"),
    )


@query(
    "is_session",
    "nyse",
    "order_days",
    sql="SELECT CAST(o.d AS VARCHAR) AS date, n_orders, n.d IS NOT NULL AS is_session FROM order_days o LEFT JOIN nyse n ON n.d = o.d",
)
def _(fx):
    return cal.is_session(order_days(fx), long_calendar(fx)).select(day(), "n_orders", "is_session")


@query(
    "sessions_between",
    "nyse",
    "order_days",
    sql="SELECT CAST(n.d AS VARCHAR) AS date, o.n_orders FROM nyse n JOIN order_days o ON o.d = n.d"
    " WHERE n.d BETWEEN DATE '2018-06-01' AND DATE '2019-07-05'",
)
def _(fx):
    wanted = cal.sessions_between(long_calendar(fx), "2018-06-01", "2019-07-05")
    return order_days(fx).join(F.broadcast(wanted.select("date")), "date").select(day(), "n_orders")


@query(
    "next_session",
    "nyse",
    "order_days",
    sql="SELECT CAST(o.d AS VARCHAR) AS date, CAST((SELECT min(n.d) FROM nyse n WHERE n.d > o.d) AS VARCHAR) AS next_session"
    " FROM order_days o",
)
def _(fx):
    return cal.next_session(order_days(fx), long_calendar(fx)).select(day(), day("next_session"))


@query(
    "premarket_cutoff",
    "nyse",
    "order_days",
    sql="SELECT CAST(n.d AS VARCHAR) AS date, CAST(540 + utc_lag AS INT) AS cutoff_utc FROM nyse n JOIN order_days o ON o.d = n.d",
)
def _(fx):
    sessions = cal.is_session(order_days(fx), long_calendar(fx)).filter("is_session")
    return cal.premarket_cutoff(sessions, long_calendar(fx)).select(day(), utc_minute("cutoff_ts", "cutoff_utc"))


# ---- records --------------------------------------------------------------------------------------------------

METRICS = ("frac_none", "frac_opening_only", "frac_sustained", "qualify_rate")


@query(
    "experiment_record",
    "stability",
    "folds",
    sql=f"SELECT s.fold_id, 'labels' AS experiment, CAST(b.train_from AS VARCHAR) AS train_from, CAST(b.test_to AS VARCHAR) AS test_to,"
    f" {LAYOUT.train_sessions} AS train_sessions, {q6s(*METRICS)} FROM stability s JOIN (SELECT fold_id,"
    " min(CASE WHEN segment = 'train' THEN d END) AS train_from, max(CASE WHEN segment = 'test' THEN d END) AS test_to FROM folds"
    " GROUP BY fold_id) b ON b.fold_id = s.fold_id",
)
def _(fx):
    record = experiment_record("labels", fold_bounds(fixture_folds(fx)), fixture_stability(fx), METRICS, {"walkforward": LAYOUT})
    folds = record.select("experiment", "config", F.explode("folds").alias("f"))
    return folds.select(
        "f.fold_id",
        "experiment",
        F.col("f.train_from").cast("string").alias("train_from"),
        F.col("f.test_to").cast("string").alias("test_to"),
        F.get_json_object("config", "$.walkforward.train_sessions").cast("int").alias("train_sessions"),
        *[r6(F.col("f.metrics")[m]).alias(m) for m in METRICS],
    )


@query(
    "unknown_news_features",
    "snapshots",
    sql=f"SELECT ticker, CAST(d AS VARCHAR) AS date, {q6('gap')} AS gap, CAST(NULL AS DOUBLE) AS news_clusters_24h, CAST(NULL AS DOUBLE) AS news_burst FROM snapshots",
)
def _(fx):
    built = session_feature_table(fx.bars, fx.calendar, None)
    return built.select("ticker", day(), *rounded("gap"), "news_clusters_24h", "news_burst")
