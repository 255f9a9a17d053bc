"""Session contract and the few helpers that touch the cluster's settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# A broadcast side must be provably below this many bytes; the bound comes from the calendar or a config,
# never from a guess about the data.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options the operators rely on: UTC instants, adaptive plans with skew handling."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast only when ``max_rows`` (a proven bound) fits the limit; else leave the join to Catalyst."""
    if max_rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df)
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one is made only for local sessions without a setting."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tapeworks-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage through the reliable checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as ``materialize`` for bulky rows: a Parquet copy in the shared folder, read back with the same schema."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def runs_at_once(keys: Sequence[int], run: Callable[[int], DataFrame], name: str, in_flight: int = 4) -> DataFrame:
    """The rows of ``run(key)`` for every key, with the key as column ``name``; at most ``in_flight`` keys at a time.

    Each key's jobs (fits included) come from a thread of their own, in a scheduler pool of their own where the cluster shares
    fairly. Its rows go to a folder of their own in the shared folder, so a lost executor costs the tasks it ran and the result is one scan,
    whatever the number of keys. All keys give the same columns. The first failure ends the run.
    """
    spark = SparkSession.active()
    path = f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"

    def one(place: int, key: int) -> StructType:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{name}-{place % in_flight}")
        rows = run(key).drop(name)
        rows.write.parquet(f"{path}/{name}={key}")
        return rows.schema

    with ThreadPoolExecutor(in_flight) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(one), i, k) for i, k in enumerate(keys)]
        try:
            schemas = [w.result() for w in waiting]
        except BaseException:
            for w in waiting:
                w.cancel()
            raise
    return spark.read.schema(StructType([*schemas[0].fields, StructField(name, IntegerType())])).parquet(path)
