"""15-minute windows and story sessions over unbounded input.

The availability latencies become watermark delays: a bar five seconds after its end, an article 15 minutes after
publishing. Both queries aggregate with bounded state that the watermark releases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import BAR_LATENCY_SECONDS, BAR_MINUTES, NEWS_LATENCY_MINUTES, WINDOW_MINUTES
from ..functions.clock import with_et
from ..functions.scalars import log_ratio
from ..functions.text import normalize_title
from ..operators.asof import rth_bars
from ..operators.news import STORY_HOURS

BARS_PER_WINDOW = WINDOW_MINUTES // BAR_MINUTES


def stream_session_windows(bars: DataFrame, calendar: DataFrame, delay: str | None = None) -> DataFrame:
    """Window measures per (ticker, window) as ``session_windows``; windows without bars do not appear in a stream.

    Bars are kept inside regular hours by a join with the calendar, a static table. A window folds the last-arrived
    version of each of its bars: versions are kept in its state, a few rows for each of its three bars, until the watermark
    passes. The session open is a multiple of 15 minutes past the hour, so windows align with the clock.
    """
    watermark = delay or f"{BAR_MINUTES * 60 + BAR_LATENCY_SECONDS} seconds"
    local = bars.drop("date", "minute", "slot").withWatermark("event_ts", watermark)
    regular = rth_bars(with_et(local), calendar)
    version = F.struct("event_ts", "available_ts", "open", "close", "volume", "vwap", "trade_count")
    grouped = regular.groupBy("ticker", F.window("event_ts", f"{WINDOW_MINUTES} minutes")).agg(F.sort_array(F.collect_list(version)).alias("all"))
    # Sorted by time, then arrival: a version followed by one of the same bar has been replaced.
    newest = F.filter("all", lambda x, i: F.coalesce(F.get("all", i + 1)["event_ts"] != x["event_ts"], F.lit(True)))
    latest = grouped.select("ticker", F.col("window.start").alias("window_start"), newest.alias("b"))
    total = lambda value: F.aggregate("b", F.lit(0.0), lambda s, x: s + F.coalesce(value(x), F.lit(0.0)))
    price = lambda x: F.coalesce(x["vwap"], x["close"])
    return latest.select(
        "ticker",
        "window_start",
        F.abs(log_ratio(F.element_at("b", -1)["close"], F.get("b", F.lit(0))["open"])).alias("r_w"),
        total(lambda x: price(x) * x["volume"]).alias("dollar_vol"),
        total(lambda x: x["trade_count"].cast("double")).cast("bigint").alias("trade_count"),
        (F.size(F.filter("b", lambda x: x["volume"] > 0)) / BARS_PER_WINDOW).alias("active_subbar_fraction"),
        F.size("b").cast("bigint").alias("n_subbars"),
    )


def stream_stories(articles: DataFrame, delay: str = f"{NEWS_LATENCY_MINUTES} minutes") -> DataFrame:
    """Stories as event-time sessions: copies of a title chain while the silence stays within 72 hours.

    An article without a title is a story of its own, under its id.
    """
    key = F.coalesce(normalize_title(F.col("title")), F.lit(""))
    own = F.concat(F.lit("\0"), F.col("article_id").cast("string"))
    titled = articles.withColumn("title_key", F.when(key != "", key).otherwise(own))
    # A session's gap is exclusive, the story rule inclusive: one microsecond more makes them agree.
    gap = f"{STORY_HOURS} hours 1 microsecond"
    grouped = titled.withWatermark("published_ts", delay).groupBy("title_key", F.session_window("published_ts", gap))
    first = F.min(F.struct("published_ts", "article_id"))
    return grouped.agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies")).select(
        F.col("first.article_id").alias("cluster_id"), F.col("first.published_ts").alias("first_published_ts"), "n_copies"
    )
