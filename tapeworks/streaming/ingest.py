"""Vendor pages that keep arriving, appended once each to the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.pages import BAR_PAGE, NEWS_PAGE, articles_from_pages, bars_from_pages
from ..sources.tables import BAR_KEY, NEWS_KEY, append_bars, append_news, stored

LEDGER = "batch_id long, rows long"


def arriving_pages(spark: SparkSession, path: str, news: bool = False, files_at_once: int = 1000) -> DataFrame:
    """Bars or articles of the JSON pages that land in a folder."""
    pages = spark.readStream.schema(NEWS_PAGE if news else BAR_PAGE).option("multiLine", True).option("maxFilesPerTrigger", files_at_once).json(path)
    return articles_from_pages(pages) if news else bars_from_pages(pages)


def _once(append: Callable[[SparkSession, str, DataFrame], int], path: str, ledger: str) -> Callable[[DataFrame, int], None]:
    """Append a batch unless the ledger has its number; the number is written last, so a batch cut short is taken up again.

    What such a batch had already appended is found by its key, so it is not added twice either.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = stored(spark, ledger)
        if done is not None and not done.filter(F.col("batch_id") == batch_id).isEmpty():
            return
        rows = append(spark, path, batch)
        spark.createDataFrame([(batch_id, rows)], LEDGER).coalesce(1).write.mode("append").parquet(ledger)

    return run


def _ingest(rows: DataFrame, key: tuple[str, ...], instant: str, delay: str, append: Callable, path: str, checkpoint: str) -> StreamingQuery:
    unique = rows.withWatermark(instant, delay).dropDuplicatesWithinWatermark(list(key))
    writer = unique.writeStream.foreachBatch(_once(append, path, f"{checkpoint}/ledger")).option("checkpointLocation", f"{checkpoint}/query")
    return writer.trigger(availableNow=True).start()


def ingest_bars(bars: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Append arriving bars to the date-partitioned table at ``path``, each version once.

    A version that comes back within ``delay`` is dropped in the stream, a later one by its key in the table. A revision
    has another availability time, so it is a version of its own: as-of reads choose between them.
    """
    return _ingest(bars, BAR_KEY, "available_ts", delay, append_bars, path, checkpoint)


def ingest_news(articles: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Append arriving articles, each id once, whatever its date."""
    return _ingest(articles, NEWS_KEY, "available_ts", delay, append_news, path, checkpoint)
