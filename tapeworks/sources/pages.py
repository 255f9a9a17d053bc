"""Landed vendor pages (JSON) to bar and news tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import BAR_LATENCY_SECONDS, BAR_MINUTES, NEWS_LATENCY_MINUTES
from ..functions.clock import shift_minutes
from ..functions.scalars import nan_to_null

BAR_PAGE = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("t", T.LongType()),
                        *[T.StructField(c, T.DoubleType()) for c in ("o", "h", "l", "c", "v")],
                        T.StructField("n", T.LongType()),
                        T.StructField("vw", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("next_url", T.StringType()),
    ]
)
NEWS_PAGE = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("published_utc", T.StringType()),
                        T.StructField("publisher", T.StructType([T.StructField("name", T.StringType())])),
                        T.StructField("title", T.StringType()),
                        T.StructField("description", T.StringType()),
                        T.StructField("keywords", T.ArrayType(T.StringType())),
                        T.StructField("tickers", T.ArrayType(T.StringType())),
                        T.StructField(
                            "insights",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("ticker", T.StringType()),
                                        T.StructField("sentiment", T.StringType()),
                                        T.StructField("sentiment_reasoning", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
        T.StructField("next_url", T.StringType()),
    ]
)


def read_payloads(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per landed page file, parsed with a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_payloads(payloads: DataFrame, schema: T.StructType, column: str = "payload") -> DataFrame:
    """Pages that already sit in a string column."""
    return payloads.select(F.from_json(column, schema).alias("page")).select("page.*")


def bars_from_pages(pages: DataFrame) -> DataFrame:
    """Explode the result arrays of every page into bars carrying the instant they became available."""
    bars = pages.select("ticker", F.explode("results").alias("r"))
    start = F.timestamp_millis("r.t")
    delay = (BAR_MINUTES * 60 + BAR_LATENCY_SECONDS) * 1_000_000
    return nan_to_null(
        bars.select(
            "ticker",
            start.alias("event_ts"),
            F.timestamp_micros(F.unix_micros(start) + F.lit(delay)).alias("available_ts"),
            F.col("r.o").alias("open"),
            F.col("r.h").alias("high"),
            F.col("r.l").alias("low"),
            F.col("r.c").alias("close"),
            F.col("r.v").alias("volume"),
            F.col("r.n").alias("trade_count"),
            F.col("r.vw").alias("vwap"),
        )
    )


def read_bar_pages(spark: SparkSession, path: str) -> DataFrame:
    return bars_from_pages(read_payloads(spark, path, BAR_PAGE))


def articles_from_pages(pages: DataFrame) -> DataFrame:
    """One row per article with its tags as array<struct<ticker, sentiment, sentiment_reasoning>>.

    A tag takes the last insight given for its ticker; without one its sentiment stays NULL.
    """
    items = pages.select(F.explode("results").alias("a")).select("a.*")
    published = F.to_timestamp("published_utc")

    def tag(ticker):
        given = F.try_element_at(F.filter("insights", lambda i: i["ticker"] == ticker), F.lit(-1))
        return F.struct(
            ticker.alias("ticker"),
            given["sentiment"].alias("sentiment"),
            given["sentiment_reasoning"].alias("sentiment_reasoning"),
        )

    no_tags = F.array().cast("array<string>")
    no_insights = F.array().cast("array<struct<ticker:string,sentiment:string,sentiment_reasoning:string>>")
    return items.withColumns(
        {"insights": F.coalesce("insights", no_insights), "tickers": F.coalesce("tickers", no_tags)}
    ).select(
        F.col("id").alias("article_id"),
        published.alias("published_ts"),
        shift_minutes(published, NEWS_LATENCY_MINUTES).alias("available_ts"),
        F.col("publisher.name").alias("publisher"),
        "title",
        "description",
        F.coalesce("keywords", no_tags).alias("keywords"),
        F.transform("tickers", tag).alias("tickers"),
    )


def read_news_pages(spark: SparkSession, path: str) -> DataFrame:
    return articles_from_pages(read_payloads(spark, path, NEWS_PAGE))


def article_tags(articles: DataFrame) -> DataFrame:
    """The (article, ticker) child table."""
    return articles.select("article_id", F.inline("tickers"))
