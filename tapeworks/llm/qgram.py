"""Benchmark decontamination: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_id, blocks, id_or_none, whole_text, where

Q = 8  # one gram is eight bytes, which is one machine word
PIECE = 100
STRIDE = 50
BUDGET = 0.1
RUN = 50  # the shortest copied run that is found at every offset of an item
RUN_STRIDE = 4
RUN_BUDGET = 4  # a run is at most RUN_STRIDE / 2 bytes beside a window, which leaves two edits
BLOCK_BYTES = 4 << 20
_SLICE = 1 << 20
_BITS = 20
_BATCH = 2048
_PERIOD = 8
_KEEP = 256  # more than any passage with its band; a run keeps so many bytes at either end
_PAIRS = 1 << 22


def normal(text: str | None) -> bytes:
    """Lower case, one space between words."""
    return b" ".join((text or "").lower().encode().split())


def shortened(text: bytes) -> tuple[bytes, np.ndarray | None]:
    """The text with long runs of a unit of up to _PERIOD bytes cut in their middle, by whole units, and where its bytes stood.

    A run keeps _KEEP bytes at either end, so every passage that is in the text is in the rest, and none is new.
    """
    raw = np.frombuffer(text, np.uint8)
    stood = None
    for unit in range(1, _PERIOD + 1):
        if len(raw) <= 2 * _KEEP:
            break
        breaks = np.concatenate(([-1], np.flatnonzero(raw[unit:] != raw[:-unit]), [len(raw) - unit]))
        begin, spare = breaks[:-1] + 1, (np.diff(breaks) - 1 + unit - 2 * _KEEP) // unit * unit
        long = spare > 0
        if not long.any():
            continue
        edge = np.zeros(len(raw) + 1, dtype=np.int8)
        np.add.at(edge, begin[long] + _KEEP, 1)
        np.add.at(edge, begin[long] + _KEEP + spare[long], -1)
        stay = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
        raw, stood = raw[stay], stay if stood is None else stood[stay]
    return (text, None) if stood is None else (raw.tobytes(), stood)


def pieces_of(text: bytes) -> list[bytes]:
    """Overlapping passages of PIECE bytes, the last flush with the end; a shorter text is one, one under Q bytes none."""
    if len(text) < Q:
        return []
    last = max(0, len(text) - PIECE)
    return [text[i : i + PIECE] for i in [*range(0, last, STRIDE), last]]


def banded_distance(piece: bytes, region: bytes, budget: int) -> tuple[int, int]:
    """Least edits that turn ``piece`` into some part of ``region``, along its diagonals, and where that part ends.

    ``region`` holds the width of the band beyond the piece; edits above ``budget`` only count as more than that.
    """
    width = len(region) - len(piece) + 1
    text = np.frombuffer(region, np.uint8)
    place = np.arange(width)
    row = np.zeros(width, dtype=np.int64)
    for i, byte in enumerate(piece):
        step = row + (text[i : i + width] != byte)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - place) + place
        if row.min() > budget:
            return budget + 1, 0
    best = int(row.argmin())
    return int(row[best]), len(piece) + best


def banded_distances(pieces: np.ndarray, raw: np.ndarray, low: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """``banded_distance`` of each row of ``pieces`` (all of one length) to the region of ``raw`` that starts at its ``low``."""
    edits, ends = np.full(len(low), budget + 1), np.zeros(len(low), dtype=np.int64)
    place = np.arange(width, dtype=np.int16)
    for at in range(0, len(low), _BATCH):
        live = np.arange(at, min(at + _BATCH, len(low)))
        text = raw[np.minimum(low[live, None] + np.arange(pieces.shape[1] + width - 1), len(raw) - 1)]
        row = np.zeros((len(live), width), dtype=np.int16)
        for i in range(pieces.shape[1]):
            step = row + (text[:, i : i + width] != pieces[live, i, None])
            step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
            row = np.minimum.accumulate(step - place, axis=1) + place
            if i % 8 == 7:
                stay = row.min(axis=1) <= budget
                live, text, row = live[stay], text[stay], row[stay]
                if not len(live):
                    break
        if len(live):
            best = row.argmin(axis=1)
            edits[live] = np.minimum(row[np.arange(len(live)), best], budget + 1)
            ends[live] = pieces.shape[1] + best
    return edits, ends


class GramIndex:
    """Pieces of a block of benchmark items and where each of their grams stands."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items, self.pieces, self.of, self.at = [], [], [], []
        items = [(item, shortened(text)[0]) for item, text in items]
        for k, (item, text) in enumerate(items):
            last = max(0, len(text) - PIECE)
            for i, piece in enumerate(pieces_of(text)):
                self.items.append(item)
                self.pieces.append(piece)
                self.of.append(k)
                self.at.append(min(i * STRIDE, last))
        self.of, self.at = np.array(self.of, dtype=np.int64), np.array(self.at, dtype=np.int64)
        self.items += [item for item, _ in items]  # a run that covers no piece has its item's own number after the pieces
        # Items stand a RUN apart, so that no window reaches into the next.
        self.whole = np.frombuffer(b"".join(t + b"\0" * RUN for _, t in items), np.uint8)
        sizes = np.array([len(t) for _, t in items], dtype=np.int64)
        self.begin = np.cumsum(sizes + RUN) - sizes - RUN
        self.last = np.maximum(0, sizes - RUN)
        self.short = sizes < RUN
        self.length = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.budget = np.minimum((self.length * BUDGET).astype(np.int64), (self.length - Q) // Q)
        self.need = self.length - Q + 1 - self.budget * Q  # the lemma: a region within the budget shares so many grams
        self.pad = int(self.budget.max(initial=0)) + 1
        owner = np.repeat(np.arange(len(self.pieces)), self.length - Q + 1)
        grams = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(p, np.uint8), Q) for p in self.pieces]
        words = np.ascontiguousarray(np.concatenate(grams)).view("<u8").ravel() if grams else np.array([], dtype="<u8")
        offset = np.concatenate([np.arange(n) for n in self.length - Q + 1]) if grams else np.array([], dtype=np.int64)
        order = np.argsort(words, kind="stable")
        self.grams, self.first = np.unique(words[order], return_index=True)
        self.upto = np.append(self.first[1:], len(words))
        self.owner, self.offset = owner[order], offset[order]
        # Grams of the items, each place once although pieces overlap.
        place = self.begin[self.of[self.owner]] + self.at[self.owner] + self.offset
        gram = np.repeat(np.arange(len(self.grams)), self.upto - self.first)
        gram, self.place = np.divmod(np.unique(gram * max(1, len(self.whole)) + place), max(1, len(self.whole)))
        self.place_first = np.searchsorted(gram, np.arange(len(self.grams)))
        self.place_upto = np.append(self.place_first[1:], len(self.place))
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[self._cell(self.grams)] = True

    @staticmethod
    def _cell(words: np.ndarray) -> np.ndarray:
        return (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)

    def _shared(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the text has grams of the index, and which."""
        count = len(raw) - Q + 1
        words = np.empty(count, dtype="<u8")
        for i in range(min(Q, count)):
            part = (count - i + Q - 1) // Q
            words[i::Q] = raw[i : i + part * Q].view("<u8")
        at = np.flatnonzero(self.maybe[self._cell(words)])
        gram = np.searchsorted(self.grams, words[at])
        gram[gram == len(self.grams)] = 0
        true = self.grams[gram] == words[at]
        return at[true], gram[true]

    @staticmethod
    def _each(first: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers from each ``first`` to before its ``upto``, and how many."""
        times = upto - first
        return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times), times

    @staticmethod
    def _spans(at: np.ndarray, pairs: np.ndarray, reach: int) -> Iterator[slice]:
        """Stretches of ``at`` with about _PAIRS pairs each; each holds ``reach`` bytes of the next one, so no passage is cut."""
        upto, low = np.cumsum(pairs), 0
        while low < len(at):
            stop = np.searchsorted(upto, (upto[low - 1] if low else 0) + _PAIRS, side="right")
            stop = max(int(stop), int(np.searchsorted(at, at[low] + reach, side="right")))
            yield slice(low, int(np.searchsorted(at, at[min(stop, len(at)) - 1] + reach, side="right")))
            low = stop

    def _pieces_found(self, raw: np.ndarray, at: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Piece, edits and end in ``raw`` of the pieces within their budget."""
        run, times = self._each(self.first[gram], self.upto[gram])
        base = int(self.length.max())
        piece, diagonal = self.owner[run], np.repeat(at, times) - self.offset[run] + base
        stride = len(raw) + 2 * base
        bands, counts = np.unique(piece * stride + diagonal // (self.budget[piece] + 1), return_counts=True)
        nxt = np.minimum(np.searchsorted(bands, bands + 1), len(bands) - 1)
        both = counts + np.where(bands[nxt] == bands + 1, counts[nxt], 0)
        # A band alone covers its own diagonals; with the next one it covers any budget + 1 in a row that start in it.
        bands = bands[both >= self.need[bands // stride]]
        of = bands // stride
        for size in np.unique(self.length[of]):
            mine = np.flatnonzero(self.length[of] == size)
            p, budget = of[mine], int(self.budget[of[mine[0]]])
            low = np.maximum(0, bands[mine] % stride * (budget + 1) - base - budget)
            rows = np.frombuffer(b"".join(self.pieces[i] for i in p), np.uint8).reshape(-1, size)
            edits, ends = banded_distances(rows, raw, low, 4 * budget + 3, budget)
            good = edits <= budget
            yield p[good], edits[good], (low + ends)[good]

    def _runs_found(self, raw: np.ndarray, at: np.ndarray, gram: np.ndarray, skip: Callable) -> tuple[np.ndarray, ...]:
        """The same for windows of RUN bytes every RUN_STRIDE of the items, with the item's number in place of the piece.

        ``skip`` tells which pairs of a place in ``raw`` and an item need no search.
        """
        run, times = self._each(self.place_first[gram], self.place_upto[gram])
        place, reach = self.place[run], len(self.whole)
        band = (np.repeat(at, times) - place + reach) // (RUN_BUDGET + 1)
        band, place = np.concatenate([band, band - 1]), np.tile(place, 2)  # each band holds the next one's grams too
        keys = np.sort((band + 1) * (2 * reach) + place)
        need, wide = RUN - Q + 1 - RUN_BUDGET * Q, RUN - Q
        first, last = keys[: max(0, len(keys) - need + 1)], keys[need - 1 :]
        near = last - first <= wide
        band, low, high = first[near] // (2 * reach) - 1, first[near] % (2 * reach), last[near] % (2 * reach)
        item = np.searchsorted(self.begin, low, side="right") - 1
        begin, end = self.begin[item], self.last[item]
        # Windows that hold all of these grams: on the grid, and the one flush with the item's end.
        a = np.maximum(0, -(-(high - wide - begin) // RUN_STRIDE))
        b = np.minimum(low - begin, end) // RUN_STRIDE
        grid, times = self._each(a, np.maximum(a, b + 1))
        flush = (end >= high - wide - begin) & (end <= low - begin)
        window = np.concatenate([np.repeat(begin, times) + grid * RUN_STRIDE, (begin + end)[flush]])
        band, item = np.concatenate([np.repeat(band, times), band[flush]]), np.concatenate([np.repeat(item, times), item[flush]])
        _, one = np.unique(band * (2 * reach) + window, return_index=True)
        start = window + band * (RUN_BUDGET + 1) - reach
        one = one[~self.short[item[one]] & ~skip(start[one] + RUN, item[one])]
        window, item, start = window[one], item[one], np.maximum(0, start[one] - RUN_BUDGET)
        edits, ends = banded_distances(self.whole[window[:, None] + np.arange(RUN)], raw, start, 4 * RUN_BUDGET + 3, RUN_BUDGET)
        good = edits <= RUN_BUDGET
        return item[good], edits[good], (start + ends)[good]

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, piece, edits, end in the text) of every piece within its budget of a part of the text.

        An item of which the text holds no piece but a run has its own number as its piece.
        """
        if not self.pieces:
            return
        reach = int(self.length.max()) + 4 * self.pad + RUN
        cut = [shortened(t) for t in texts]
        texts = [t for t, _ in cut]
        parts = [(k, s) for k, t in enumerate(texts) for s in range(0, max(1, len(t)), _SLICE)]
        gap = b"\n" * reach
        raw = np.frombuffer(gap + gap.join(texts[k][s : s + _SLICE + 2 * reach] for k, s in parts) + gap, np.uint8)
        sizes = np.array([min(_SLICE + 2 * reach, max(0, len(texts[k]) - s)) for k, s in parts], dtype=np.int64)
        starts = reach + np.concatenate(([0], np.cumsum(sizes[:-1] + reach))) if len(parts) else np.array([], dtype=np.int64)
        at, gram = self._shared(raw)
        if not len(at):
            return
        owner, offset = np.array(parts, dtype=np.int64).T
        part_of = lambda place: np.maximum(0, np.searchsorted(starts, place, side="right") - 1)
        held: set[int] = set()
        count = len(self.begin)
        stood = lambda text, end: end if cut[text][1] is None else int(cut[text][1][end - 1]) + 1
        least: dict[tuple[int, int], tuple[int, int]] = {}

        def note(k: np.ndarray, what: np.ndarray, edits: np.ndarray, end: np.ndarray) -> None:
            for text, i, e, z in zip(owner[k].tolist(), what.tolist(), edits.tolist(), (end - starts[k] + offset[k]).tolist()):
                a, b = least.get((text, i), (e, z))
                least[text, i] = min(a, e), min(b, z)

        for span in self._spans(at, (self.upto - self.first)[gram], reach):
            for p, edits, end in self._pieces_found(raw, at[span], gram[span]):
                k = part_of(end)
                held.update((owner[k] * count + self.of[p]).tolist())
                note(k, p, edits, end)
        known = np.array(sorted(held), dtype=np.int64)
        skip = lambda place, item: np.isin(owner[part_of(place)] * count + item, known)
        for span in self._spans(at, (self.place_upto - self.place_first)[gram], reach):
            item, edits, end = self._runs_found(raw, at[span], gram[span], skip)
            k = part_of(end)
            new = ~np.isin(owner[k] * count + item, known)
            note(k[new], len(self.pieces) + item[new], edits[new], end[new])
        for (text, i), (e, z) in least.items():
            yield text, i, e, stood(text, z)


def _indexes(benchmark: DataFrame) -> Iterator[GramIndex]:
    """The benchmark in blocks of about BLOCK_BYTES, each small enough to broadcast."""
    size = F.octet_length(whole_text()).cast("long")
    count = max(1, -(-(benchmark.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES))
    for block in range(count):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block) if count > 1 else benchmark
        rows = part.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).toArrow()
        yield GramIndex([(i, normal(t)) for i, t in zip(rows["item_id"].to_pylist(), rows["text"].to_pylist())])


def _search(index: GramIndex) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1):
            ids = batch.column(0).to_pylist()
            texts = [b" ".join(t.split()) for t in batch.column(1).to_pylist()]
            rows = [(ids[k], index.items[p], p, edits, end) for k, p, edits, end in index.find(texts)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["_id", "item_id", "piece", "edits", "end"])

    return run


def _folded(docs: DataFrame):
    return F.encode(F.lower(whole_text()), "UTF-8").alias("_folded")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, pieces, edits and end: one row for each document and benchmark item that it holds a passage of.

    Texts are lower-cased, with one space between words. Every item is cut into passages of PIECE bytes, one each STRIDE,
    so any copied run of PIECE + STRIDE bytes covers one; a shorter item is one passage. A document holds a passage if a
    part of it is within BUDGET edits a byte (fewer for passages under 40 bytes, so that the lemma needs a gram). ``pieces``
    counts the passages found, ``edits`` is the least of theirs and ``end`` where the first ends in the folded text. Where no such
    passage is found, windows of RUN bytes every RUN_STRIDE of the item are looked for with RUN_BUDGET edits; they count as one.
    Of a run of one unit of up to _PERIOD bytes only _KEEP bytes at either end are looked at, in items and texts: the rest
    repeats them, and a passage of such an item counts once for each place left.

    A passage within the budget shares so many Q-grams with the text, all on budget + 1 neighbouring diagonals; grams are
    counted in bands of twice that width, each overlapping the next, and bands with enough are verified by alignment.
    Null and blank texts hold nothing, items under Q bytes can't be found, rows without an item_id report a null one,
    repeated rows count as one document, empty tables give no rows; other columns are ignored. The benchmark is read in
    broadcast blocks of bounded size, however large; documents are not shuffled.
    """
    result = None
    rows = docs.select(id_or_none().alias("_id"), _folded(docs))
    for index in _indexes(benchmark):
        found = rows.mapInArrow(_search(index), "_id long, item_id long, piece long, edits int, end long")
        result = found if result is None else result.unionByName(found)
    per_piece = result.groupBy("_id", "item_id", "piece").agg(F.min("edits").alias("edits"), F.min("end").alias("end"))
    return per_piece.groupBy("_id", "item_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.min("edits").alias("edits"), F.min("end").alias("end")
    ).select(as_id("_id").alias("doc_id"), "item_id", "pieces", "edits", "end")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark, with their own columns; rows are judged one by one, in place."""
    for index in _indexes(benchmark):

        def clean(texts: list[bytes], index: GramIndex = index) -> np.ndarray:
            stay = np.ones(len(texts), dtype=bool)
            stay[[k for k, *_ in index.find([b" ".join(t.split()) for t in texts])]] = False
            return stay

        docs = where(docs, _folded(docs), clean)
    return docs
