"""Shards cut from a Hilbert order of the metadata, so that each file covers a small box of every dimension."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType, LongType
from pyspark.sql.window import Window

from tapeworks.runtime import checkpoint_dir

from .common import id_or_none, keep, whole_text
from .hilbert import hilbert_index

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 4
BINS = 4096
SPLITS = 2048


def _number(head: Column) -> Column:
    """Six bytes, filled up with zeros, as a long that keeps their order."""
    return F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("long")


def _text_bin(column: Column, least: str | None, most: str | None) -> Column:
    """One of BINS even steps between the least and the largest value, by the six bytes after what both start with."""
    low, high = (least or "").encode(), (most or "").encode()
    shared = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    value = lambda raw: int.from_bytes(raw[shared : shared + 6].ljust(6, b"\0"), "big")
    head = F.substring(F.encode(column, "UTF-8"), shared + 1, 6)
    width = max(1, value(high) - value(low))
    return F.floor((_number(head) - F.lit(value(low))) * (BINS - 1) / F.lit(width))


def _number_bin(column: Column) -> Column:
    """The number's bit length and its next six bits: finer steps for small numbers, 64 a doubling."""
    size = F.abs(column.cast("long"))
    length = F.char_length(F.bin(size))
    shifted = F.when(length > 7, F.call_function("shiftright", size, (length - 7).cast("int"))).otherwise(size)
    return F.signum(column.cast("double")).cast("long") * (F.greatest(length - 7, F.lit(0)) * 64 + shifted)


def _binned(docs: DataFrame, dimensions: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """id, size, crc32 and a bin for each dimension; null has a bin before all others."""
    numeric = {f.name for f in docs.schema.fields if isinstance(f.dataType, IntegralType)}
    words = [d for d in dimensions if d not in numeric]
    ends = docs.agg(*[g(F.col(d).cast("string")).alias(f"{d}_{n}") for d in words for n, g in (("lo", F.min), ("hi", F.max))] or [F.lit(0)]).first()
    lowest = F.lit(-(2**62))
    bins = [
        F.coalesce(_number_bin(F.col(d)) if d in numeric else _text_bin(F.col(d).cast("string"), ends[f"{d}_lo"], ends[f"{d}_hi"]), lowest).alias(f"_bin{i}")
        for i, d in enumerate(dimensions)
    ]
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), id_or_none().alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *bins, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    )


@F.pandas_udf(LongType())
def _curve(cells: pd.DataFrame) -> pd.Series:
    return pd.Series(hilbert_index(cells.to_numpy(), BITS))


def hilbert_shards(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = DIMENSIONS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the ``carry`` columns; each row has one shard.

    Each dimension is cut into 2^BITS cells of about equal counts: texts by their leading bytes, numbers by a logarithmic
    scale, null first, equal values always together. Cells give a place on a Hilbert curve; rows in that order, within
    a cell by a hash, then doc_id, are cut into runs of equal bytes (law ``bytes``): no run is further from the mean
    than the largest row's size. A size is the text's UTF-8 bytes plus 8, 8 for a null text. An empty table gives no
    row; repeated rows lie side by side; grown_shard is null, as it belongs to another law.

    The histograms hold BINS + 1 bins a text dimension and 3,776 at most a number; the cells are 2^(BITS x dimensions).
    A cell that holds many rows is split by a hash into as many parts as its share of SPLITS, so no part and no task
    grows with one value, and the tables of parts stay below their fixed bounds.
    """
    checkpoint_dir(docs.sparkSession)
    binned = _binned(docs, dimensions, carry)
    rows = keep(binned) if not carry else binned
    facts = rows if not carry else keep(binned.drop(*[f"_c{i}" for i in range(len(carry))]))
    totals = facts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n, total = max(1, totals["n"]), max(1, totals["bytes"])

    celled, celled_facts = rows, facts
    for i in range(len(dimensions)):
        before = F.coalesce(F.sum("m").over(Window.orderBy(f"_bin{i}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = facts.groupBy(f"_bin{i}").agg(F.count(F.lit(1)).alias("m"))
        cells = cells.select(f"_bin{i}", F.floor((2 * before + F.col("m")) * (1 << BITS) / F.lit(2 * n)).cast("int").alias(f"_cell{i}"))
        celled, celled_facts = (f.join(F.broadcast(cells), f"_bin{i}") for f in (celled, celled_facts))
    curve = _curve(F.struct(*[f"_cell{i}" for i in range(len(dimensions))]))
    celled, celled_facts = (f.withColumn("curve", curve) for f in (celled, celled_facts))

    parts = celled_facts.groupBy("curve").agg((F.floor(F.count(F.lit(1)) * SPLITS / F.lit(n)) + 1).alias("parts"))
    salt = F.pmod(F.xxhash64("_id", "text_crc32"), F.col("parts")).alias("part")
    split, split_facts = (f.join(F.broadcast(parts), "curve").withColumn("part", salt) for f in (celled, celled_facts))
    through = Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        split_facts.groupBy("curve", "part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("m"))
        .select("curve", "part", F.coalesce(F.sum("b").over(through), F.lit(0)).alias("b0"), F.coalesce(F.sum("m").over(through), F.lit(0)).alias("m0"))
    )
    inside = Window.partitionBy("curve", "part").orderBy("_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        split.join(F.broadcast(starts), ["curve", "part"])
        .withColumn("_upto", F.col("b0") + F.sum("size").over(inside))
        .withColumn("_place", F.col("m0") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"int(least({shards - 1}, (2 * _upto - size) * {shards} div {2 * total}))"))
    )
    facts_placed = placed.select("shard", "_place")
    firsts = F.broadcast(facts_placed.groupBy("shard").agg(F.min("_place").alias("_first")))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_place") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet a shard, rows by slot; each shard's files hold one run of the curve."""
    (
        sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").mode("overwrite").parquet(path)
    )


def box_overlap(sharded: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Per shard the least and largest value of each carried dimension: what file pruning sees."""
    bounds = [g(d).alias(f"{d}_{n}") for d in dimensions for n, g in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)

