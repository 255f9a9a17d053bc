"""SimHash near-dedup: exact links between fingerprints by comparing tiles of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import NO_ID, as_id, binary_text, blocks, id_or_none, keep, whole_text, word_runs
from .components import components

SEED = 42
SHINGLE = 4
RADIUS = 4
TILE = 16_384
_CHUNK = 1 << 18


def _majority(hashes: list[int]) -> np.ndarray:
    values = np.array(hashes, dtype="<u8")
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's word shingles; 0 without words."""
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in word_runs(text.lower()):
        words = tail + words
        tail = words[max(0, len(words) - size + 1) :]
        if len(words) < size:
            tail = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]
        for i in range(0, len(hashes), 1 << 15):
            ones += _majority(hashes[i : i + (1 << 15)])
        total += len(hashes)
    if not total and tail:
        ones, total = _majority([xxhash.xxh64_intdigest(b" ".join(tail), SEED)]), 1
    bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, 0):
        prints = pa.array([fingerprint(t) for t in batch.column(0).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], prints], names=[*batch.schema.names[1:], "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """_id and print (the 64 bits as a long) of every whole text."""
    return docs.select(binary_text(whole_text()).alias("t"), id_or_none().alias("_id")).mapInArrow(_fingerprints, "_id long, print long")


def _quarter_counts(prints: np.ndarray) -> np.ndarray:
    quarters = prints[:, None] >> np.array([0, 16, 32, 48], dtype=np.uint64) & np.uint64(0xFFFF)
    return np.bitwise_count(quarters).astype(np.int16)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, then b) that span what ``a`` and ``b`` link: never more than one pair a fingerprint.

    Within the tiles, groups of rows whose quarters' bit counts alone differ by more than the radius are not compared.
    """
    shift = 0 if same else len(a)
    label = np.arange(len(a) + (0 if same else len(b)))
    left, right = [], []
    counts_a, counts_b = _quarter_counts(a), _quarter_counts(b)
    groups_a, of_a = np.unique(counts_a, axis=0, return_inverse=True)
    groups_b, of_b = np.unique(counts_b, axis=0, return_inverse=True)
    fine = len(a) > 4 * len(groups_a)
    order = np.argsort(of_a, kind="stable") if fine else np.arange(len(a))
    edges = np.flatnonzero(np.diff(of_a[order])) + 1 if fine else np.array([], dtype=np.int64)
    for rows in np.split(order, edges):
        cols = np.arange(len(b))
        if fine:
            near = np.abs(groups_b - counts_a[rows[0]]).sum(axis=1) <= radius
            cols = np.flatnonzero(near[of_b])
        if not len(cols) or not len(rows):
            continue
        other, step = b[cols], max(1, _CHUNK // len(cols))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            r, c = np.nonzero(np.bitwise_count(a[part, None] ^ other[None, :]) <= radius)
            u, v = label[part[r]], label[shift + cols[c]]
            while (apart := u != v).any():
                u, v = u[apart], v[apart]
                pairs = np.unique(np.minimum(u, v) * len(label) + np.maximum(u, v))
                low, high = pairs // len(label), pairs % len(label)
                target, first = np.unique(high, return_index=True)  # each root hangs on one smaller root at most
                moved = np.arange(len(label))
                moved[target] = low[first]
                left.append(low[first])
                right.append(target)
                while (next_ := moved[moved]).tobytes() != moved.tobytes():
                    moved = next_
                label, u, v = moved[label], moved[u], moved[v]
    empty = np.array([], dtype=np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for i in range(batch.num_rows):
                pa_, la, pb, lb = (np.asarray(batch.column(k)[i].values) for k in range(4))
                same = batch.column(4)[i].as_py()
                x, y = _forest(pa_.view(np.uint64), pb.view(np.uint64), same, radius)
                ids = la if same else np.concatenate([la, lb])
                us.append(ids[x])
                vs.append(ids[y])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(print, low) of distinct fingerprints -> (u, v) of their low ids: edges that connect what lies within ``radius``.

    Fingerprints are dealt to cells by the bit counts of their two halves, and cells to tiles of about TILE by hash.
    Two tiles are compared only if the counts of their cells differ by ``radius`` or less in sum, as more can't be
    within it: a table of cells and of the 41 steps around each lists the tile pairs, by equality. Each pair is one row
    and one piece of work; its output is a spanning forest, so a dense group of n never makes n squared links.
    """
    halves = [F.bit_count(F.col("print").bitwiseAND(2**32 - 1)).cast("int"), F.bit_count(F.shiftrightunsigned("print", 32)).cast("int")]
    celled = prints.select("print", "low", halves[0].alias("a"), halves[1].alias("b"))
    cells = keep(celled.groupBy("a", "b").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts")))
    spread = celled.join(F.broadcast(cells), ["a", "b"])  # 33 x 33 cells at most
    tiles = spread.groupBy("a", "b", F.pmod(F.xxhash64("print"), F.col("parts")).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("print", "low"))).alias("rows")
    )
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s")
    one = cells.select("a", "b", "parts", step).select("a", "b", "parts", (F.col("a") + F.col("s.i")).alias("a2"), (F.col("b") + F.col("s.j")).alias("b2"))
    two = cells.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("parts").alias("parts2"))
    pairs = one.join(two, ["a2", "b2"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    own = (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))
    pairs = pairs.filter(~own | (F.col("part") <= F.col("part2"))).withColumn("same", own & (F.col("part") == F.col("part2")))
    pairs = pairs.select("a", "b", "part", "a2", "b2", "part2", "same")
    other = tiles.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("part").alias("part2"), F.col("rows").alias("rows2"))
    met = pairs.join(tiles, ["a", "b", "part"]).join(other, ["a2", "b2", "part2"])
    return met.select("rows.print", "rows.low", F.col("rows2.print").alias("print2"), F.col("rows2.low").alias("low2"), "same").mapInArrow(
        _compare(radius), "u long, v long"
    )


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    The fingerprint is over lower-cased (A-Z) words and their 4-word shingles, repeats included; a shorter text is one
    shingle, a null or blank one has fingerprint zero and links like any other. Documents link at ``radius`` differing
    bits or fewer; component_id is the least doc_id reachable. Rows that share a doc_id are one document, a null doc_id
    comes before all others (its component_id is null); an empty table gives no row; other columns are ignored.

    Equal fingerprints are one node from the start, with the least doc_id as its name.
    """
    rows = keep(fingerprints(docs))
    nodes = keep(rows.groupBy("print").agg(F.min("_id").alias("low")))
    repeated = rows.groupBy("_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).filter(F.col("p") != F.col("q"))
    shared = rows.join(repeated, "_id").join(nodes, "print").select(F.col("_id").alias("u"), F.col("low").alias("v"))
    groups = components(links(nodes, radius).union(shared))
    named = nodes.join(groups, nodes["low"] == groups["node"], "left").select("print", F.coalesce("component", "low").alias("component"))
    return rows.join(named, "print").select(
        as_id("_id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), as_id("component").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group, the one with the least doc_id, with its own columns; one row of a repeated doc_id."""
    groups = near_groups(docs, radius).select("doc_id", "component_id").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = groups.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_stay")).distinct()
    named = docs.withColumn("_own", id_or_none())
    kept = named.join(stay, named["_own"] == stay["_stay"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("_own").orderBy(F.xxhash64(whole_text())))
    return kept.withColumn("_nth", nth).filter(F.col("_nth") == 1).select(*docs.columns)


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component of fingerprints, the one with the least doc_id (a null one first), with its own columns.

    Only texts link rows: those that share a doc_id, or have none, stay or go like any others. Of rows with the same
    doc_id and text one stays. The choice is a minimum over ids and text hashes; texts move once, by both.
    """
    text, names = whole_text(), ["_own", "_own1", "_own2"]
    own = [id_or_none().alias("_own"), F.xxhash64(text).alias("_own1"), F.xxhash64(F.lit(1), text).alias("_own2")]
    rows = docs.select(binary_text(text).alias("t"), *own).mapInArrow(_fingerprints, "_own long, _own1 long, _own2 long, print long")
    nodes = keep(rows.groupBy("print").agg(F.min(F.struct(*names)).alias("least")))
    groups = components(links(nodes.select("print", F.col("print").alias("low")), radius))
    named = nodes.join(groups, nodes["print"] == groups["node"], "left").groupBy(F.coalesce("component", "print")).agg(F.min("least").alias("least"))
    # The join leaves rows in the order of their names, so that repeated ones drop out without another sort of texts.
    return docs.select("*", *own).join(named.select("least.*"), names, "left_semi").dropDuplicates(names).select(*docs.columns)
