"""Articles published once by id: versions of rows and ids, of which an append reads only what may hold its ids.

A published version is a folder of rows, a folder of their ids in hash buckets, and a Bloom filter for each bucket. A version counts
once its number has been claimed; folders without a claim are never read. Two writers cannot claim one number: the second one
finds it taken and starts again from what the first one published.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HASHES = 6
BITS_PER_ID = 12  # one id in about 300 is looked up in vain for each version
BUCKETS = 64


def _place(key: str, words, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), F.col(key)), words * F.lit(64))


class Ledger:
    """The versions at ``path`` for rows identified by the column ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "article_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._home = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims")
        self._files = self._home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _claims(self) -> list[str]:
        """Names of the claimed numbers, in order; checksum files of local folders do not count."""
        if not self._files.exists(self._home):
            return []
        return sorted(n for n in (f.getPath().getName() for f in self._files.listStatus(self._home)) if n.isdigit())

    def versions(self) -> list[str]:
        """Folder names of the published versions, oldest first; a claim that a writer did not live to sign holds none."""
        claims = self._claims()
        if not claims:
            return []
        signed = self.spark.read.text([f"{self.path}/claims/{c}" for c in claims]).select("value", F.input_file_name().alias("claim"))
        return [r["value"] for r in signed.orderBy("claim").collect()]

    def rows(self) -> DataFrame | None:
        """All published rows."""
        versions = self.versions()
        return self.spark.read.parquet(*[f"{self.path}/rows/{v}" for v in versions]) if versions else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def may_hold(self, ids: DataFrame, versions: list[str]) -> list[str]:
        """The folders of ids whose filters let any of ``ids`` pass."""
        blooms = self.spark.read.parquet(*[f"{self.path}/blooms/{v}" for v in versions])
        met = ids.withColumn("bucket", self._bucket()).join(blooms, "bucket")
        words = F.size("bits").cast("long")
        passes = F.lit(True)
        for i in range(HASHES):
            place = _place(self.key, words, i)
            word = F.get("bits", F.shiftright(place, 6).cast("int"))
            passes = passes & (F.getbit(word, place.bitwiseAND(63).cast("int")) == 1)
        found = met.filter(passes).select("version", "bucket").distinct().collect()
        return [f"{self.path}/ids/{r['version']}/bucket={r['bucket']}" for r in found]

    def fresh(self, incoming: DataFrame, versions: list[str]) -> DataFrame:
        """Incoming rows whose id no version holds, one for each id."""
        unique = incoming.dropDuplicates([self.key])
        folders = self.may_hold(unique.select(self.key), versions) if versions else []
        if not folders:
            return unique
        return unique.join(self.spark.read.parquet(*folders).select(self.key), self.key, "left_anti")

    def _filters(self, ids: DataFrame, version: str) -> DataFrame:
        most = ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        words = 1 << max(0, (-(-most * BITS_PER_ID // 64) - 1).bit_length())
        places = F.explode(F.array(*[_place(self.key, F.lit(words), i) for i in range(HASHES)])).alias("place")
        bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
        set_words = ids.select("bucket", places).groupBy("bucket", F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))

        def filled(group: pa.Table) -> pa.Table:
            bits = np.zeros(words, dtype=np.int64)
            bits[np.asarray(group["word"])] = np.asarray(group["bits"])
            return pa.table({"bucket": group["bucket"].slice(0, 1), "bits": pa.array([bits.tolist()], pa.list_(pa.int64()))})

        return set_words.groupBy("bucket").applyInArrow(filled, "bucket int, bits array<long>").withColumn("version", F.lit(version))

    def _claim(self, number: int, version: str) -> bool:
        """Take a number for a version; false if another writer has it."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self._home, f"{number:09d}")
        try:
            out = self._files.create(target, False)
        except Exception as problem:
            if self._files.exists(target):
                return False
            raise problem
        out.write(bytearray(version.encode()))
        out.close()
        return True

    def publish(self, incoming: DataFrame) -> int:
        """Publish the incoming rows whose ids are new; returns how many. Nothing is visible before all of it is written."""
        while True:
            number, versions = len(self._claims()), self.versions()
            name = f"v-{uuid.uuid4().hex}"
            self.fresh(incoming, versions).write.parquet(f"{self.path}/rows/{name}")
            rows = self.spark.read.parquet(f"{self.path}/rows/{name}")
            count = rows.count()
            if not count:
                return 0
            ids = rows.select(self.key, self._bucket().alias("bucket"))
            ids.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/ids/{name}")
            self._filters(ids, name).coalesce(1).write.parquet(f"{self.path}/blooms/{name}")
            if self._claim(number, name):
                return count
