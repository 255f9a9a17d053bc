"""Market-shaped inputs derived by Spark from the generated tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.config import BAR_LATENCY_SECONDS, BAR_MINUTES, NEWS_LATENCY_MINUTES, BreakoutConfig, LabelConfig
from tapeworks.config import SweepConfig, WalkForwardConfig
from tapeworks.functions.clock import exchange_instant
from tapeworks.functions.text import classify_event
from tapeworks.operators.asof import rth_bars
from tapeworks.sources.calendar import session_calendar

FIRST_DAY, LAST_DAY = "2024-01-01", "2024-01-31"
HALF_DAY = "2024-01-12"  # an invented early close, to exercise half days
FIT, SPAN = ("2024-01-02", "2024-01-17"), ("2024-01-18", "2024-01-31")
LAYOUT = WalkForwardConfig(
    train_sessions=8, test_sessions=3, step_sessions=3, calibrate_sessions=2, embargo_sessions=1, holdout_sessions=2
)
# Thresholds lowered to the fixture's thin tape (a month of sessions, a few ticks per bar).
LABEL = LabelConfig(
    k_move=0.5, p_vol=0.5, p_trades=0.5, n_min_trades=2, f_min_active=0.3, min_obs=5, min_late_windows=2
)
BREAKOUT = BreakoutConfig()
SWEEP = SweepConfig()
FIT_MIN_OBS = 5


class Fixture:
    """Lazily derived tables of one data directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def calendar(self) -> DataFrame:
        return session_calendar(self.spark, FIRST_DAY, LAST_DAY, {HALF_DAY: 780})

    @cached_property
    def ticks(self) -> DataFrame:
        """A day of events squeezed into the extended session: 450 s of real time make one five-minute bar."""
        seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
        each = self.table("events").select(
            "event_id",
            F.col("ts").cast("date").alias("d"),
            (240 + 5 * F.floor(seconds / 450)).cast("int").alias("m"),
            F.concat(F.lit("T"), (F.col("user_id") % 3).cast("string")).alias("ticker"),
            (100 + F.col("value") / 10).alias("px"),
            F.col("value").alias("qty"),
        )
        return each.unionByName(each.withColumn("ticker", F.lit("SPY")))

    @cached_property
    def bars(self) -> DataFrame:
        """Five-minute bars with their exchange date and minute; VWAP is unknown for single-tick bars."""
        bars = self.ticks.groupBy("ticker", "d", "m").agg(
            F.min_by("px", "event_id").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "event_id").alias("close"),
            F.sum("qty").alias("volume"),
            F.count(F.lit(1)).alias("trade_count"),
            F.when(F.count(F.lit(1)) > 1, F.sum(F.col("px") * F.col("qty")) / F.sum("qty")).alias("vwap"),
        )
        start = exchange_instant(F.col("d"), F.col("m"))
        latency = (BAR_MINUTES * 60 + BAR_LATENCY_SECONDS) * 1_000_000
        return bars.withColumns(
            {"event_ts": start, "available_ts": F.timestamp_micros(F.unix_micros(start) + F.lit(latency))}
        ).withColumnsRenamed({"d": "date", "m": "minute"})

    @cached_property
    def revised_bars(self) -> DataFrame:
        """All bars, plus a correction of each full-hour bar that arrives two hours later."""
        late = self.bars.filter(F.col("minute") % 60 == 0).withColumns(
            {"close": F.col("close") + 1, "available_ts": F.expr("available_ts + INTERVAL 2 HOURS")}
        )
        return self.bars.unionByName(late)

    @cached_property
    def rth(self) -> DataFrame:
        return rth_bars(self.bars, self.calendar)

    @cached_property
    def daily(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        return self.table("orders").groupBy(F.col("o_orderpriority").alias("ticker"), day.alias("date")).agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        """News from the documents: first line as title, whole text as description, publish minutes in exchange time.

        The generated table is one small file, so it is spread over the cores before its text is parsed.
        """
        labels = self.table("labels")
        pub_min = ((F.col("doc_id") % 1000) * 43).cast("int")
        sentiment = (
            F.when(F.col("toxic") == 1, "negative")
            .when(F.col("quality") == 1, "positive")
            .when(F.col("quality").isNotNull(), "neutral")
        )
        published = exchange_instant(F.lit(FIRST_DAY).cast("date"), F.col("pub_min"))
        documents = self.table("documents").select("doc_id", "text", "source").repartition("doc_id")
        docs = documents.join(labels, "doc_id", "left").withColumn("pub_min", pub_min)
        return docs.select(
            F.col("doc_id").alias("article_id"),
            published.alias("published_ts"),
            F.timestamp_micros(F.unix_micros(published) + NEWS_LATENCY_MINUTES * 60_000_000).alias("available_ts"),
            F.col("source").alias("publisher"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("description"),
            F.concat(F.lit("T"), (F.col("doc_id") % 3).cast("string")).alias("ticker"),
            sentiment.alias("sentiment"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        return self.articles.select("article_id", "ticker", "sentiment")

    @cached_property
    def typed_articles(self) -> DataFrame:
        return self.articles.withColumn("event_type", classify_event(F.col("title"), F.col("description")))
