"""Idempotent appends to Parquet tables, and result sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.clock import local_time

BAR_KEY = ("ticker", "event_ts", "available_ts")
NEWS_KEY = ("article_id",)


def require_instants(df: DataFrame, *columns: str) -> DataFrame:
    """Reject wall-clock timestamps: event and availability times must be instants."""
    for name in columns:
        if not isinstance(df.schema[name].dataType, T.TimestampType):
            raise ValueError(f"{name} must be timezone-aware (timestamp, not {df.schema[name].dataType.simpleString()})")
    return df


def new_rows(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key. A revision differs in available_ts, so it is new."""
    return incoming.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def new_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return new_rows(existing, require_instants(incoming, "event_ts", "available_ts"), BAR_KEY)


def new_articles(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return new_rows(existing, require_instants(incoming, "published_ts", "available_ts"), NEWS_KEY)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none yet; a table that cannot be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _append(spark: SparkSession, path: str, incoming: DataFrame, key: tuple[str, ...], instant: str) -> int:
    rows = incoming.withColumn("date", F.to_date(local_time(F.col(instant))))
    table = stored(spark, path)
    if table is None:
        fresh = rows.dropDuplicates(list(key))
    else:
        if instant in key:
            # The date follows from the key, so only the partitions the batch touches can hold it: two dates come back.
            low, high = rows.agg(F.min("date"), F.max("date")).first()
            if low is None:
                return 0
            table = table.filter(F.col("date").between(low, high))
        # Other keys can be stored under any date; the scan reads the key columns alone.
        fresh = new_rows(table, rows, key)
    # Rebalancing gathers each date into well-sized files and splits a date that is too large for one task. The rows are
    # kept while they are counted and written, so both see the same ones.
    kept = fresh.hint("rebalance", "date").persist()
    try:
        count = kept.count()
        if count:
            kept.write.mode("append").partitionBy("date").parquet(path)
        return count
    finally:
        kept.unpersist()


def append_bars(spark: SparkSession, path: str, incoming: DataFrame) -> int:
    """Append unseen bars (and revisions) to the date-partitioned table; returns the rows added."""
    return _append(spark, path, require_instants(incoming, "event_ts", "available_ts"), BAR_KEY, "event_ts")


def append_news(spark: SparkSession, path: str, incoming: DataFrame, start=None, end=None) -> int:
    """Append unseen articles published in [start, end); returns the articles added."""
    batch = require_instants(incoming, "published_ts", "available_ts")
    if start is not None:
        batch = batch.filter(F.col("published_ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        batch = batch.filter(F.col("published_ts") < F.lit(end).cast("timestamp"))
    return _append(spark, path, batch, NEWS_KEY, "published_ts")


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").option("header", True).csv(path)


def write_trades(trades: DataFrame, path: str) -> None:
    """Trade list in time order: range-partitioned, so files and the rows within them are ordered."""
    ordered = trades.repartitionByRange("date", "minute").sortWithinPartitions("date", "minute", "ticker")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def record_experiment(records: DataFrame, path: str) -> None:
    """Append-only experiment log, one JSON document per experiment."""
    records.write.mode("append").json(path)
