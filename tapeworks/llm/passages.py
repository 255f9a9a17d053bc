"""Substring dedup by words: take out the words of passages that an earlier document holds too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_id, binary_text, blocks, id_or_none, table, whole_text, word_runs
from .fmindex import FMIndex

LENGTH = 50  # words of a window
ANCHOR = 16  # words of a window's anchor
SPAN = LENGTH - ANCHOR  # how far an anchor may stand from its window's start
SHARD = 2048  # surroundings that share an index
CROWD = 2048  # an anchor with more different surroundings than this is split by the words next to it
HOT_ROWS = 1 << 20  # of 16 bytes at most are broadcast
_AROUND = SPAN + LENGTH  # words from a window's start within which all that matters to it lies
_SLICE = 1 << 17  # window starts of a long text that are handled together


class _Hashes(dict):
    """Words to 64 bits, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30)) ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0xD1342543DE82EF95) + b, 5)


def slices(data: bytes) -> Iterator[tuple[list[bytes], int, int, int, int]]:
    """A text as word lists with margins: words, number of the first, first and last window start that the list answers
    for (both from the list's start; none if last < first), and words from the list's start to the end of the text, if known."""
    held, offset, first = [], 0, 0
    for run in word_runs(data):
        held += run
        ready = offset + len(held) - _AROUND
        if ready > first + _SLICE:
            yield held, offset, first - offset, ready - 1 - offset, len(held)
            first = ready
            cut = max(0, first - SPAN - offset)
            held, offset = held[cut:], offset + cut
    yield held, offset, first - offset, len(held) - LENGTH, len(held)


def anchors(hashes: np.ndarray, parts: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
    """Part, first word, anchor, last word + 1 (all from the array's start), anchor hash and hash of the surroundings.

    A part of the array is its begin, first and last window start and end. A window's anchor is its gram of ANCHOR words with
    the least hash, the leftmost of equals, so that equal windows have equal anchors at equal distance. Its surroundings
    are all words that windows with that anchor can cover, cut off where the text ends; their hash tells also where.
    """
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    if len(hashes) < LENGTH:
        return empty
    grams = _mix(hashes, 3)
    for size in (1, 2, 4, 8):
        grams = _paired(grams[:-size], grams[size:])
    wide = _paired(grams[:-ANCHOR], grams[ANCHOR:])
    bits = np.uint64(len(grams).bit_length())
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size <= SPAN:
        step = min(size, SPAN + 1 - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    steps = np.zeros(len(hashes) + 1, dtype=np.int8)
    for _, first, last, _ in parts:
        if last >= first:
            steps[first] += 1
            steps[last + 1] -= 1
    at = (least[np.cumsum(steps[: len(least)], dtype=np.int8) > 0] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.diff(at, prepend=-1) != 0]
    begins, ends = np.array([p[0] for p in parts]), np.array([p[3] for p in parts])
    part = np.searchsorted(begins, at, side="right") - 1
    low, high = np.maximum(at - SPAN, begins[part]), np.minimum(at + LENGTH, ends[part])
    cut = ((at - low) * 256 + (high - at)).astype(np.uint64)
    middle = (low + high) // 2 - ANCHOR
    return part, low, at, high, grams[at], _paired(_paired(wide[low], wide[middle]), _mix(wide[high - 2 * ANCHOR] + cut, 9))


def _anchored(batch: pa.RecordBatch, column: int, hashes: _Hashes) -> Iterator[tuple]:
    """Row, words, number of the first word of the list, and (first word, anchor, last word + 1, hashes) of its anchors, list by list."""
    rows, lists, parts = [], [], []
    begin = 0

    def flush() -> Iterator[tuple]:
        flat = np.concatenate([np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) for words, _ in lists])
        part, *found = anchors(flat, parts)
        bounds = np.searchsorted(part, np.arange(len(parts) + 1))
        for k, (row, (words, offset)) in enumerate(zip(rows, lists)):
            low, at, high, anchor, around = (c[bounds[k] : bounds[k + 1]] for c in found)
            shift = parts[k][0]
            yield row, words, offset, low - shift, at - shift, high - shift, anchor, around

    for row, data in enumerate(batch.column(column)):
        for words, offset, first, last, end in slices(data.as_py()):
            if begin and begin + len(words) > 2 * _SLICE:
                yield from flush()
                rows, lists, parts, begin = [], [], [], 0
            rows.append(row)
            lists.append((words, offset))
            parts.append((begin, begin + first, begin + last, begin + end))
            begin += len(words)
    if lists:
        yield from flush()


def _signed(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes).view(np.int64)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of lists of longs."""
    offsets, values = column.offsets.to_pylist(), np.asarray(column.values)
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, tag, anchor, around) of the anchors of each text, equal surroundings of a list of words once."""
    hashes = _Hashes()
    for batch in blocks(batches, 2):
        ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        found = []
        for row, _, _, _, _, _, anchor, around in _anchored(batch, 2, hashes):
            if len(anchor):
                _, one = np.unique(around, return_index=True)
                found.append((np.full(len(one), row), anchor[one], around[one]))
        if found:
            row, anchor, around = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[row], tags[row], _signed(anchor), _signed(around))], names=["_id", "tag", "anchor", "around"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around the anchors that a text is asked for, each once."""
    hashes = _Hashes()
    for batch in blocks(batches, 0):
        asked = [np.sort(a) for a in _lists(batch.column(1))]
        left = [set(a.tolist()) for a in asked]
        key, sub, lead, text, wins = [], [], [], [], []
        for row, words, _, low, at, high, anchor, around in _anchored(batch, 0, hashes):
            around = _signed(around)
            for k in np.flatnonzero(np.isin(around, asked[row])).tolist():
                name = int(around[k])
                if name in left[row]:
                    left[row].discard(name)
                    key.append(int(_signed(anchor[k : k + 1])[0]))
                    sub.append(name)
                    lead.append(int(at[k] - low[k]))
                    wins.append(int(high[k] - low[k]) - LENGTH + 1)
                    text.append(b" ".join(words[low[k] : high[k]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(sub, pa.int64()), pa.array(lead, pa.int32()), pa.array(wins, pa.int32()), pa.array(text, pa.binary())],
            names=["anchor", "around", "lead", "wins", "text"],
        )


def _judge_shard(group: pa.Table) -> pa.Table:
    """(key, sub, low, wins, mask): which windows of each text an earlier document holds, by one index over the shard.

    The texts are indexed, and streamed through the index; every window's interval tells the least document that holds it.
    """
    low = np.asarray(group["low"])
    names: dict[bytes, int] = {}
    texts = [np.array([names.setdefault(w, len(names) + 1) for w in t.split()], dtype=np.int64) for t in group["text"].to_pylist()]
    index = FMIndex(texts, LENGTH)
    text, start, first, last = index.windows(texts)
    gone = index.least(first, last, low) < low[text]
    mask = np.zeros(len(texts), dtype=np.int64)
    np.bitwise_or.at(mask, text[gone], np.int64(1) << start[gone])
    return group.select(["key", "sub", "low", "wins"]).append_column("mask", pa.array(mask))


def halves(words: list[bytes] | bytes, lead: int, core: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Split the windows over a core in two: by whether they go on behind it or begin before it for about half of the rest.

    Yields first and last word + 1 of what such windows cover, and the lead and first and last word + 1 of their longer core.
    """
    rest = LENGTH - core
    half = rest // 2
    first, stop = max(0, lead - half), min(len(words), lead + core + rest)
    if stop - first >= LENGTH and lead + core + rest - half <= stop:
        yield first, stop, lead - first, lead, lead + core + rest - half
    if lead > half and rest:
        first, stop = max(0, lead - rest), min(len(words), lead - half - 1 + LENGTH)
        if stop - first >= LENGTH:
            yield first, stop, lead - half - 1 - first, lead - half - 1, lead + core


def _splitter(spaced: bool) -> Callable:
    """Halves of rows whose texts are words, or bytes if they are not ``spaced``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda seed, text: xxhash.xxh3_64_intdigest(text, seed) - (1 << 63)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                units = row["text"].split() if spaced else row["text"]
                for first, stop, lead, begin, end in halves(units, row["lead"], row["core"]):
                    core, text = (b" ".join(u) if spaced else u for u in (units[begin:end], units[first:stop]))
                    rows.append((
                        row["key"], row["sub"], row["low"], row["high"], first, digest(end - begin, core), digest(lead, text),
                        lead, end - begin, stop - first - LENGTH + 1, text,
                    ))
            if rows:
                types = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.binary()]
                names = ["parent", "parent_sub", "low", "high", "off", "key", "sub", "lead", "core", "wins", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def full(wins: str) -> Column:
    return F.expr(f"shiftleft(1L, {wins}) - 1")


def decide(level: DataFrame, judge: Callable = _judge_shard, spaced: bool = True) -> DataFrame:
    """(key, sub, low, wins, mask) of the rows of a written table, one row for each key and sub, as ``judge`` finds them in a shard.

    Keys are dealt to shards of about SHARD texts. A key that more than CROWD different texts share is not: its rows are split in
    two by longer keys, whose equal texts fall together, and those that two documents share are decided in the same way. A
    key of LENGTH words has one text only, so at most six rounds follow.
    """
    hot = table(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key"))
    crowded = hot.count()
    ready = level
    if crowded:
        few = F.broadcast(hot) if crowded <= HOT_ROWS else hot
        ready = level.join(few, "key", "left_anti")
    shards = max(1, -(-level.count() // SHARD))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    result = ready.groupBy(shard).applyInArrow(judge, "key long, sub long, low long, wins int, mask long")
    if not crowded:
        return result
    child = "parent long, parent_sub long, low long, high long, off int, key long, sub long, lead int, core int, wins int, text binary"
    parts = table(level.join(few, "key", "left_semi").select("key", "sub", "low", "high", "lead", "core", "text").mapInArrow(_splitter(spaced), child))
    same = parts.groupBy("key", "sub").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), *(F.first(c).alias(c) for c in ("lead", "core", "wins", "text"))
    )
    shared = parts.groupBy("key").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).filter("_low < _high").select("key")
    below = decide(table(same.join(shared, "key").select("key", "sub", "low", "high", "lead", "core", "wins", "text")), judge, spaced)
    below = below.select("key", "sub", F.col("low").alias("_low"), "mask")
    mask = F.when(F.col("low") > F.col("_low"), full("wins")).otherwise(F.col("mask"))
    joined = parts.select("parent", "parent_sub", "low", "off", "key", "sub", "wins").join(below, ["key", "sub"])
    found = joined.withColumn("mask", mask).groupBy("parent", "parent_sub").agg(F.bit_or(F.expr("shiftleft(mask, off)")).alias("mask"))
    found = found.select(F.col("parent").alias("key"), F.col("parent_sub").alias("sub"), "mask")
    return result.union(level.join(few, "key", "left_semi").join(found, ["key", "sub"]).select("key", "sub", "low", "wins", "mask"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in blocks(batches, 1):
        texts, names_of, masks_of = batch.column(1), _lists(batch.column(2)), _lists(batch.column(3))
        sizes, gone = [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
        rows = np.flatnonzero([len(names) for names in names_of])
        if len(rows):
            for row, _, offset, low, _, _, _, around in _anchored(pa.RecordBatch.from_arrays([texts.take(pa.array(rows))], names=["t"]), 0, hashes):
                row = int(rows[row])
                order = np.argsort(names_of[row])
                names, masks = names_of[row][order], masks_of[row][order]
                at = np.minimum(np.searchsorted(names, _signed(around)), len(names) - 1)
                hit = names[at] == _signed(around)
                bits = (masks[at[hit], None] >> np.arange(SPAN + 1)) & 1
                gone[row].append((low[hit][:, None] + offset + np.arange(SPAN + 1))[bits == 1])
        removed, kept = [], []
        for row in range(batch.num_rows):
            runs, parts, lost = word_runs(texts[row].as_py()), [], 0
            starts = np.unique(np.concatenate(gone[row])) if gone[row] else np.zeros(0, dtype=np.int64)
            for words in runs:
                begin, end = sizes[row], sizes[row] + len(words)
                sizes[row] = end
                inside = starts[np.searchsorted(starts, begin - LENGTH, side="right") : np.searchsorted(starts, end)]
                if len(inside):
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(steps, np.maximum(inside - begin, 0), 1)
                    np.add.at(steps, np.minimum(inside + LENGTH - begin, len(words)), -1)
                    out = np.cumsum(steps[:-1]) > 0
                    lost += int(out.sum())
                    words = [words[i] for i in np.flatnonzero(~out).tolist()]
                if words:
                    parts.append(b" ".join(words))
            removed.append(lost)
            kept.append(b" ".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["_id", "n_words", "n_removed", "kept"]
        )


def drop_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (bytes; words joined by one space) of every row: what no earlier document holds.

    Words are what ASCII blanks separate; a null or blank text has none. A word goes if LENGTH words in a row over it also
    stand in a document with a smaller doc_id; windows overlap, are judged on the input and never cross documents. Rows that
    share a doc_id are not earlier than each other; rows without one come before all others; texts of fewer words lose
    nothing; an empty table gives no row; other columns are ignored.

    An index per shard answers for the windows whose anchors fall there, so equal windows of different documents meet in one
    shard and no document passes through all of them. Anchors that a single document holds are dropped by a map-side
    aggregate of hashes; the words around the others are fetched once from the least document that holds them, indexed, and
    streamed through backward search. What it finds out is joined back to every document that has the same surroundings.
    """
    text = whole_text()
    own = (id_or_none().alias("_id"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int").alias("tag"))
    texts = docs.select(*own, binary_text(text).alias("t"))
    every = table(texts.mapInArrow(_occurrences, "_id long, tag int, anchor long, around long"))
    several = every.groupBy("anchor").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).filter("low < high").select("anchor")
    shared = table(every.join(several, "anchor").distinct())
    first = F.min(F.struct("_id", "tag")).alias("first")
    around = shared.groupBy("anchor", "around").agg(first, F.max("_id").alias("high"))
    around = table(around.select("anchor", "around", "first._id", "first.tag", "high"))
    asked = around.groupBy("_id", "tag").agg(F.collect_list("around").alias("asked"))
    fetched = texts.join(asked, ["_id", "tag"]).select("t", "asked").mapInArrow(_surroundings, "anchor long, around long, lead int, wins int, text binary")
    fetched = fetched.groupBy("anchor", "around").agg(*(F.first(c).alias(c) for c in ("lead", "wins", "text")))  # rows may repeat
    named = around.select("anchor", "around", F.col("_id").alias("low"), "high")
    level = named.join(fetched, ["anchor", "around"]).select(
        F.col("anchor").alias("key"), F.col("around").alias("sub"), "low", "high", "lead", F.lit(ANCHOR).alias("core"), "wins", "text"
    )
    judged = decide(table(level)).select(F.col("key").alias("anchor"), F.col("sub").alias("around"), "low", "wins", "mask")
    mask = F.when(F.col("_id") > F.col("low"), full("wins")).otherwise(F.col("mask")).alias("mask")
    marks = shared.join(judged, ["anchor", "around"]).select("_id", "tag", "around", mask).filter("mask != 0")
    per_text = marks.groupBy("_id", "tag").agg(F.collect_list(F.struct("around", "mask")).alias("marks"))
    listed = (F.coalesce(F.col(f"marks.{c}"), F.array().cast("array<long>")).alias(c) for c in ("around", "mask"))
    cut = texts.join(per_text, ["_id", "tag"], "left").select("_id", "t", *listed).mapInArrow(_cut, "_id long, n_words long, n_removed long, kept binary")
    return cut.select(as_id("_id").alias("doc_id"), "n_words", "n_removed", "kept")
