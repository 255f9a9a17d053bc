"""Approximate nearest neighbours from windows of several shifted Hilbert orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import keep
from .hilbert import hilbert_index

ORDERS = 24
DIMS = 8
BITS = 6
SHARE = 0.02
LEAST = 64
BLOCK = 2048
CHUNK = 25_600
SEED = 5


def _bases(width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each order an orthonormal projection and a shift."""
    rng = np.random.default_rng(SEED)
    dims = min(DIMS, width)
    return np.stack([np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(ORDERS)]), rng.random((ORDERS, dims))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """uid, vec_id and v of the vectors that take part: of the commonest length, finite, not zero."""
    kind = vectors.schema[column].dataType
    element = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    v = F.col(column).cast(f"array<{element}>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(good & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.col("count").desc(), "k").limit(1).collect()
    width = lengths[0]["k"] if lengths else 0
    return keep(rows.filter(F.size("v") == width).withColumn("uid", F.monotonically_increasing_id()))


def ranks(base: DataFrame, count: int) -> DataFrame:
    """(uid, turn, rank): each vector's place in every order, from 0, ties by uid.

    Every order is the Hilbert curve through a shifted grid over a projection; rows of all orders are sorted by ranges of
    (turn, key) over all tasks, and a table of range sizes turns places within a range into ranks.
    """
    first = base.select(F.size("v").alias("k")).limit(1).collect()
    width = first[0]["k"] if first else 1
    bases, shifts = _bases(width)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(shifts.shape, np.inf), np.full(shifts.shape, -np.inf)
        for batch in batches:
            y = np.einsum("nw,owd->ond", _matrix(batch.column(0)), bases)
            if y.shape[1]:
                low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(low.size)), pa.array(low.ravel()), pa.array(high.ravel())], names=["cell", "low", "high"])

    low, high = np.zeros(shifts.size), np.ones(shifts.size)
    for row in base.select("v").mapInArrow(extremes, "cell long, low double, high double").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        if np.isfinite(row["low"]):
            low[row["cell"]], high[row["cell"]] = row["low"], row["high"]
    low, span = low.reshape(shifts.shape), np.maximum(high - low, 1e-300).reshape(shifts.shape)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, top = _matrix(part.column(1)), (1 << BITS) - 1
                for turn in range(ORDERS):
                    place = ((x @ bases[turn] - low[turn]) / span[turn] + shifts[turn]) / 2
                    key = hilbert_index(np.clip((place * (1 << BITS)).astype(np.int64), 0, top), BITS)
                    turns = np.full(len(key), turn, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(turns), pa.array(key)], names=["uid", "turn", "key"])

    keyed = base.select("uid", "v").mapInArrow(keys, "uid long, turn int, key long")
    placed = keep(keyed.repartitionByRange("turn", "key", "uid").sortWithinPartitions("turn", "key", "uid").select("uid", "turn", F.monotonically_increasing_id().alias("row")))
    part = F.shiftright("row", 33)
    upto = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("m")).select("part", upto.alias("start"))
    rank = F.col("start") + F.col("row").bitwiseAND(2**33 - 1) - F.col("turn") * F.lit(count)
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("uid", "turn", rank.alias("rank"))


def _nearest(top: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                field = lambda k: batch.column(k)[i].values
                ask, ask_rank, ask_v = np.asarray(field(0)), np.asarray(field(1)), _matrix(field(2))
                uid, ids, rank, v = np.asarray(field(3)), np.asarray(field(4)), np.asarray(field(5)), _matrix(field(6))
                out: list[tuple[np.ndarray, ...]] = []
                for q, r, x in zip(ask, ask_rank, ask_v):
                    near = np.flatnonzero((np.abs(rank - r) <= window) & (uid != q))
                    score = np.sqrt(((v[near] - x) ** 2).sum(axis=1))
                    best = np.lexsort((uid[near], ids[near], score))[:top]
                    out.append((np.full(len(best), q), uid[near][best], ids[near][best], score[best]))
                columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=["ask", "uid", "vec_id", "score"])

    return run


def neighbours(vectors: DataFrame, every: int = 100, top: int = 10, column: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` nearest found of every row whose vec_id is divisible by ``every``.

    Nearness is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id. A
    query's candidates are the rows within LEAST + ``share`` x rows places of it in any of ORDERS Hilbert orders, its own
    row left out; all candidates are compared exactly. Vectors that are null, zero, not of the commonest length or hold
    null or non-finite components take no part, nor do rows without a vec_id; rows that repeat a vec_id are rows of their
    own; an empty table gives no row; other columns are ignored.

    Orders are cut into blocks of BLOCK rows; queries go to the blocks that their windows meet, in lists bounded by CHUNK
    places of the order, so neither side of a comparison grows with the data.
    """
    base = usable(vectors, column)
    count = base.count()
    window = LEAST + int(share * count)
    placed = ranks(base, count).join(base, "uid")
    blocks = placed.groupBy("turn", F.expr(f"rank div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("uid", "vec_id", "rank", "v")).alias("rows"))
    reach = F.sequence(F.expr(f"greatest(0, rank - {window}) div {BLOCK}"), F.expr(f"least({max(0, count - 1)}, rank + {window}) div {BLOCK}"))
    asked = placed.filter(F.col("vec_id") % every == 0).select("turn", F.expr(f"rank div {CHUNK}").alias("chunk"), "uid", "rank", "v", F.explode(reach).alias("block"))
    asks = asked.groupBy("turn", "block", "chunk").agg(F.collect_list(F.struct("uid", "rank", "v")).alias("asks"))
    met = asks.join(blocks, ["turn", "block"]).select("asks.uid", "asks.rank", "asks.v", F.col("rows.uid").alias("uid2"), "rows.vec_id", F.col("rows.rank").alias("rank2"), F.col("rows.v").alias("v2"))
    found = met.mapInArrow(_nearest(top, window), "ask long, uid long, vec_id long, score double")
    merged = found.groupBy("ask", "uid").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))
    best = Window.partitionBy("ask").orderBy("score", "vec_id", "uid")
    ranked = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    names = base.select(F.col("uid").alias("ask"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "ask").select("query_id", "rank", "vec_id", "score")
