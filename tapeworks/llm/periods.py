"""Periodic runs: stretches of words that repeat with a period, found from minimizers of several scales."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_text, blocks, whole_text, word_runs

LEAST, TIMES = 6, 4  # a run has at least so many words, and so many periods
SHORT = 8  # longest period that a scan of its own lag finds
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E6C63D0676A9A99)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0x9E6D62D06F6A9A9B)
    return x ^ (x >> np.uint64(30))


def _joined(grams: np.ndarray, size: int) -> np.ndarray:
    """Hashes of grams twice as long from those of ``size`` words."""
    return _mixed(grams[:-size] * np.uint64(0xD1342543DE82EF95) + grams[size:])


def short_runs(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Starts, lengths and the period of the runs with a period of up to SHORT: one scan for each lag."""
    for q in range(1, min(SHORT, len(ids) - 1) + 1):
        edges = np.flatnonzero(np.diff(ids[q:] == ids[:-q], prepend=False, append=False))
        begin, size = edges[::2], edges[1::2] - edges[::2] + q
        long = size >= max(LEAST, TIMES * q)
        begin, size = begin[long], size[long]
        for r in (r for r in range(1, q) if q % r == 0):
            repeats = np.ones(len(begin), dtype=bool)
            for j in range(q - r):
                repeats &= ids[begin + j] == ids[begin + j + r]
            begin, size = begin[~repeats], size[~repeats]  # the smaller period's scan has them
        yield begin, size, q


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost least hash of every ``window`` places in a row."""
    bits = np.uint64(len(grams).bit_length())
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size < window:
        step = min(size, window - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at[np.diff(at, prepend=-1) != 0]


def seeds(ids: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and lags of equal minimizers next to each other, scale by scale, for documents of up to ``longest`` words.

    The scale of k-grams serves the periods q with k/2 < q <= k. Inside such a run, equal k-grams are multiples of q apart,
    as a gram holds a whole period. A window of k/2 + 1 grams covers 3k/2 words; a run of 4q words holds it and its copy q words
    on, whose minimizer is the same gram q words on. So two selected places next to each other in the list of one gram are q apart.
    """
    grams, size = _mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), 1
    while TIMES * (size // 2 + 1) <= longest:
        if size > SHORT:
            at = minimizers(grams, size // 2 + 1)
            order = at[np.argsort(grams[at], kind="stable")]
            lag = np.diff(order)
            found = (grams[order[1:]] == grams[order[:-1]]) & (lag > size // 2) & (lag <= size)
            yield order[:-1][found], lag[found]
        grams, size = _joined(grams, size), 2 * size


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many first items agree."""
    done, step, end = 0, 64, min(len(a), len(b))
    while done < end:
        differs = a[done : min(done + step, end)] != b[done : min(done + step, end)]
        first = int(differs.argmax())
        if differs[first]:
            return done + first
        done, step = done + len(differs), 2 * step
    return end


def _primitive(root: np.ndarray) -> bool:
    """Whether a word sequence is no power of a shorter one."""
    n, rest, factor = len(root), len(root), 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            if np.array_equal(root[n // factor :], root[: n - n // factor]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def long_runs(ids: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and period of the runs with periods above SHORT: seeds extended both ways, each stretch once."""
    for at, lag in seeds(ids, longest):
        order = np.lexsort((at, lag))
        reach = of = -1
        for i, q in zip(at[order].tolist(), lag[order].tolist()):
            if q == of and i < reach:
                continue
            stop = i + _agreement(ids[i:], ids[i + q :])
            start = i - _agreement(ids[:i][::-1], ids[: i + q][::-1])
            of, reach = q, stop
            if stop + q - start >= TIMES * q and _primitive(ids[start : start + q]):
                yield start, stop + q - start, q


def runs_in(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence, by start, then period."""
    parts = [np.stack([b, s, np.full(len(b), q)], axis=1) for b, s, q in short_runs(ids)]
    parts.append(np.array(list(long_runs(ids, longest)), dtype=np.int64).reshape(-1, 3))
    rows = np.concatenate(parts)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids, which word stands at each place once the words from one place on repeat."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % period)


def _judge(rows: list[tuple[int | None, bytes]], plant: bool) -> pa.RecordBatch:
    """The runs of a few texts at once, laid one behind the other with a mark between them that is like no other."""
    names: dict[bytes, int] = {}
    texts = []
    for doc_id, data in rows:
        parts = [np.fromiter((names.setdefault(w, len(names)) for w in part), np.int32, len(part)) for part in word_runs(data)]
        ids = np.concatenate(parts)
        order = planted(doc_id, len(ids)) if plant else None
        texts.append(ids if order is None else ids[order])
    words = list(names)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    marks = np.arange(-1, -len(texts) - 1, -1, dtype=np.int32)
    found = runs_in(np.concatenate([x for t, m in zip(texts, marks) for x in (t, [m])]).astype(np.int32), int(sizes.max()))
    owner = np.searchsorted(begins, found[:, 0], side="right") - 1
    ends = np.searchsorted(owner, np.arange(len(texts)), side="right")
    first, kept = 0, []
    for ids, begin, last in zip(texts, begins, ends):
        if last > first:
            mine = found[first:last]
            mine[:, 0] -= begin
            steps = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(steps, mine[:, 0] + mine[:, 2], 1)
            np.add.at(steps, mine[:, 0] + mine[:, 1], -1)
            ids = ids[np.cumsum(steps[:-1]) == 0]
        kept.append(b" ".join(map(words.__getitem__, ids.tolist())))
        first = last
    runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], fields=list(_RUN))
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), runs)
    columns = [pa.array([d for d, _ in rows], pa.int64()), pa.array(sizes), runs, pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "kept"])


def _find(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1):
            yield _judge(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), plant)

    return run


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and kept (bytes) of every row.

    Words are what ASCII blanks separate; a null or blank text has none. A run is a stretch of words with smallest period q and
    at least ``max(LEAST, TIMES * q)`` words that no neighbour extends. ``kept`` joins by one space the words that no run holds after its
    first period. Rows that share a doc_id, or have none, are judged each for itself; an empty table gives no row; other
    columns are ignored. ``plant`` first makes the ends of a tenth of the documents periodic, so that a run is known to be there.

    No row needs another: there is no shuffle. Short texts share a block of a megabyte; a long text stands alone in arrays in
    proportion to its words. Extension visits each repetition once, so work stays near n log n whatever repeats.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text(whole_text()).alias("t"))
    return rows.mapInArrow(_find(plant), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary")
