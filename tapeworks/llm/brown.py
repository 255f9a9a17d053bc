"""LM scoring with Brown classes: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_id, binary_text, blocks, crc_of_id, id_or_none, table, whole_text, word_runs

END = b""
SEEDS = 1000  # words whose classes start the exchange
LEAST = 3  # words found less often get a class by spelling
PASSES = 2
CLASSES = 48
SWEEPS = 8
HEAD = 200_000  # words that travel as numbers; all others meet theirs in a join
HEAD_BYTES = 64
WORD_BYTES = 32
PRIOR = 50.0
_GRAMS = 1 << 14
_FLUSH = 200_000
_SLICE = 1 << 20
_TOGETHER = 1 << 21  # tokens whose neighbours are added up at once
_OPEN = CLASSES + 1  # stands for a neighbour without a class yet
_KINDS = CLASSES + 2


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each word of a square table of bigram counts; the first and the last word keep classes of their own.

    Words start dealt out by rank and are moved, one after the other, to the class that raises the likelihood of the
    class bigrams most, until a sweep moves none or ``sweeps`` are done.
    """
    n = len(pairs)
    of = np.concatenate(([0], 1 + np.arange(n - 2) % classes, [classes + 1]))
    size = classes + 2
    grid = np.zeros((size, size))
    np.add.at(grid, (of[:, None], of[None, :]), pairs)
    entropy = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(sweeps):
        moves = 0
        for w in range(1, n - 1):
            out, into = np.bincount(of, pairs[w], size), np.bincount(of, pairs[:, w], size)
            own, a = pairs[w, w], of[w]
            out[a] -= own
            into[a] -= own
            grid[a] -= out
            grid[:, a] -= into
            grid[a, a] -= own
            cells = entropy(grid)
            gain = (entropy(grid + out) - cells).sum(1) + (entropy(grid + into[:, None]) - cells).sum(0)
            d = np.diag(grid)
            gain += entropy(d + out + into + own) + entropy(d) - entropy(d + out) - entropy(d + into)
            rows, cols = grid.sum(1), grid.sum(0)
            gain -= entropy(rows + out.sum() + own) - entropy(rows) + entropy(cols + into.sum() + own) - entropy(cols)
            best = 1 + int(np.argmax(gain[1:-1]))
            best = a if gain[best] <= gain[a] + 1e-9 else best
            grid[best] += out
            grid[:, best] += into
            grid[best, best] += own
            moves += best != a
            of[w] = best
        if not moves:
            break
    return of


def _gram_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams of marked words, at most WORD_BYTES from either end, and where each word starts."""
    marked = [b"^" + (w if len(w) <= 2 * WORD_BYTES else w[:WORD_BYTES] + w[-WORD_BYTES:]) + b"$" for w in words]
    raw = np.frombuffer(b"".join(marked) + b"\0\0", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    cells = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)
    ends = starts + lengths
    cells[ends - 1] = _GRAMS
    cells[ends - 2] = _GRAMS
    return cells, starts


def spelling(words: list[bytes], counts: np.ndarray, of: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Log shares of trigram cells within each class, to give a class to words too rare for the exchange."""
    grid = np.zeros((_GRAMS + 1, classes))
    if words:
        cells, starts = _gram_table(words)
        lengths = np.diff(np.append(starts, len(cells)))
        np.add.at(grid, (cells, np.repeat(of - 1, lengths)), np.repeat(np.sqrt(counts), lengths))
    grid = np.log((grid + 0.1) / (grid[:-1].sum(0) + 0.1 * _GRAMS))
    grid[-1] = 0
    return grid.astype(np.float32)


class Speller:
    """Classes by spelling, in a second set after those of the exchange."""

    def __init__(self, grid: np.ndarray):
        self.grid, self.known = grid, {}

    def classes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _FLUSH:
            self.known = {}
        new = list({w for w in words if w not in self.known})
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            cells, starts = _gram_table(part)
            best = np.add.reduceat(self.grid[cells], starts, axis=0).argmax(axis=1) + 1 + self.grid.shape[1]
            self.known.update(zip(part, best.tolist()))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def __getstate__(self):
        return self.grid

    def __setstate__(self, state):
        self.grid, self.known = state, {}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    for batch in blocks(batches, 1):
        for text in batch.column(1).to_pylist():
            for words in word_runs(text.lower()):
                found.update(words)
            found[END] += 1
        if len(found) > _FLUSH:
            yield rows()
            found.clear()
    if found:
        yield rows()


def _number(head) -> Callable:
    """Texts as numbers of words: 1 to H in the head, from H + 1 on the place in the text's own list of other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, beyond = head.value.get, len(head.value) + 1
        for batch in blocks(batches, 1):
            numbers, rest = [], []
            for text in batch.column(1).to_pylist():
                own: dict[bytes, int] = {}
                parts = []
                for words in word_runs(text.lower()):
                    ids = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
                    for i in np.flatnonzero(ids == 0).tolist():
                        ids[i] = beyond + own.setdefault(words[i], len(own))
                    parts.append(ids.tobytes())
                numbers.append(b"".join(parts))
                rest.append(list(own))
            arrays = [batch.column(0), batch.column(2), pa.array(numbers, pa.binary()), pa.array(rest, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "held", "numbers", "rest"])

    return run


def _sequence(values: list[bytes], kind: type) -> np.ndarray:
    """The numbers of several texts in a row, each text between two ends."""
    end = np.zeros(1, kind).tobytes()
    return np.frombuffer(end + b"".join(v + end for v in values), kind)


def _count_pairs(column: int, kind: type, of: np.ndarray | None, size: int) -> Callable:
    """Counts of neighbouring classes, ends of texts included; numbers beyond ``of`` have its last class. One row a pair and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(size * size, dtype=np.int64)
        for batch in blocks(batches, column):
            whole = _sequence(batch.column(column).to_pylist(), kind)
            for i in range(0, len(whole) - 1, _SLICE):
                part = whole[i : i + _SLICE + 1]
                classes = (part if of is None else of[np.minimum(part, len(of) - 1)]).astype(np.int64)
                totals += np.bincount(classes[:-1] * size + classes[1:], minlength=size * size)
        cells = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(totals[cells])], names=["cell", "n"])

    return run


def _pair_table(texts: DataFrame, column: str, kind: type, of: np.ndarray | None, size: int) -> np.ndarray:
    run = _count_pairs(0, kind, of, size)
    counted = texts.select(column).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    grid = np.zeros(size * size)
    for row in counted.toLocalIterator():  # size x size cells at most, whatever the corpus
        grid[row["cell"]] = row["n"]
    return grid.reshape(size, size)


def _packed(keys: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """A row for each word, numbered as in ``keys``: its cells, each a byte followed by a count of at most 255, larger counts in several."""
    width = 2 * _KINDS
    found.sort()
    first = np.flatnonzero(np.diff(found, prepend=-1))
    counts = np.diff(first, append=len(found))
    times = -(-counts // 255)
    codes, n = np.repeat(found[first], times), np.full(times.sum(), 255)
    n[np.cumsum(times) - 1] = counts - 255 * (times - 1)
    pairs = np.stack([codes % width, n], axis=1).astype(np.uint8)
    words = codes // width
    start = np.flatnonzero(np.diff(words, prepend=-1))
    offsets = np.append(2 * start, pairs.size).astype(np.int32)
    cells = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(pairs)])
    return pa.RecordBatch.from_arrays([pa.array(keys[words[start]]), cells], names=["key", "cells"])


def _neighbours(keys, of: np.ndarray) -> Callable:
    """How often each word has each class before it (cells below _KINDS) and after it; words add up over _TOGETHER tokens of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, beyond, seen = np.int32(2 * _KINDS), len(of) - 1, 0
        codes, names, cells = [], [], []

        def rows():
            others, place = np.unique(np.concatenate(names or [keys.value[:0]]), return_inverse=True)
            for name, cell in zip(np.split(place, np.cumsum([len(x) for x in names])[:-1]), cells):
                codes.extend((beyond + name.astype(np.int32)) * width + cell)
            return _packed(np.concatenate([keys.value, others]), np.concatenate(codes))

        for batch in blocks(batches, 0):
            whole = _sequence(batch.column(0).to_pylist(), np.int32)
            others = batch.column(1)
            sizes = np.asarray(pa.compute.binary_length(batch.column(0)), dtype=np.int64) // 4
            begin = 1 + np.cumsum(sizes + 1) - sizes - 1
            first = np.asarray(others.offsets, dtype=np.int64)[:-1]
            spelled = np.asarray(others.values, dtype=np.int64)
            for i in range(0, len(whole) - 1, _SLICE):
                part = whole[max(0, i - 1) : i + _SLICE + 1]
                classes = of[np.minimum(part, beyond)]
                word, left, right = part[1:-1], classes[:-2], classes[2:] + np.uint8(_KINDS)
                inside = (word > 0) & (word < beyond)  # the end has a class of its own
                at = word[inside] * width
                codes += [at + left[inside], at + right[inside]]
                out = np.flatnonzero(word >= beyond)
                text = np.searchsorted(begin, out + max(0, i - 1) + 1, side="right") - 1
                names.append(spelled[first[text] + word[out] - beyond])
                cells.append(np.stack([left[out], right[out]]))
                seen += len(word)
                if seen >= _TOGETHER:
                    yield rows()
                    codes, names, cells, seen = [], [], [], 0
        if seen:
            yield rows()

    return run


def fit(grid: np.ndarray) -> np.ndarray:
    """What one neighbour of each class before (first rows) or after (last rows) a word adds to its likelihood in each class.

    With class bigrams N(a, b), a word in c adds log N(a, c) / N(c) for a class a before it and log N(c, b) / N(c) for b after it.
    """
    cells, inner = grid + 0.5, slice(1, CLASSES + 1)
    before = np.log(cells[:, inner]) - np.log(cells.sum(0)[inner])
    after = np.log(cells[inner]).T - np.log(cells.sum(1)[inner])
    return np.concatenate([before, after])


def _choose(weights: np.ndarray) -> Callable:
    """key and class of words found LEAST times, from rows sorted by key; a word at the end of a batch may go on in the next."""

    def best(keys: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        enough = seen[:, :_KINDS].sum(axis=1) >= LEAST
        of = 1 + (seen[enough] @ weights).argmax(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(keys[enough]), pa.array(of.astype(np.int32))], names=["key", "of"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(weights)
        last, held = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([last, np.asarray(batch.column(0))])
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            pairs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 2)
            word = np.repeat((np.cumsum(new) - 1)[len(last) :], np.asarray(pa.compute.binary_length(batch.column(1))) // 2)
            seen = np.bincount(word * width + pairs[:, 0], pairs[:, 1], new.sum() * width).reshape(-1, width)
            seen[: len(held)] += held
            keys = keys[new]
            yield best(keys[:-1], seen[:-1])
            last, held = keys[-1:], seen[-1:].copy()
        yield best(last, held)

    return run


def _best_classes(training: DataFrame, keys, of: np.ndarray) -> DataFrame:
    """key and class of every word found LEAST times: the class of best likelihood by all its neighbours, as classed by ``of``."""
    weights = fit(_pair_table(training, "numbers", np.int32, of, _KINDS))
    named = training.select("numbers", F.transform("rest", lambda w: F.xxhash64(w)).alias("keys"))
    found = named.mapInArrow(_neighbours(keys, of), "key long, cells binary")
    return found.repartition("key").sortWithinPartitions("key").mapInArrow(_choose(weights), "key long, of int")


def _among(keys) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.sort(keys.value)
        for batch in batches:
            found = np.asarray(batch.column(0))
            at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            yield batch.filter(pa.array(wanted[at] == found))

    return run


def _name(fixed: dict[bytes, int], speller: Speller) -> Callable:
    """word, n and class: ``fixed`` ones first, then those of the exchange, then by spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 0):
            words = batch.column(0).to_pylist()
            of = [fixed.get(w, c) for w, c in zip(words, batch.column(2).to_pylist())]
            bare = [i for i, c in enumerate(of) if c is None]
            for i, c in zip(bare, speller.classes([words[i] for i in bare]).tolist()):
                of[i] = c
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of, pa.int32())], names=["word", "n", "of"])

    return run


def _class_texts(head, speller: Speller) -> Callable:
    """Texts as classes, a byte each, with the number of known tokens and the sum of log10(count + 1), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, logs, known = head.value
        beyond = len(of)
        for batch in blocks(batches, 2):
            rest, found = batch.column(3), batch.column(4)
            counts = np.diff(np.asarray(rest.offsets, dtype=np.int64))
            first, words, seen = np.cumsum(counts) - counts, rest.flatten(), found.flatten()
            met = np.asarray(pa.compute.list_value_length(found).fill_null(0), dtype=np.int64)
            place = np.repeat(first, met) + np.asarray(seen.field("pos"))
            own, own_logs = np.zeros(len(words), np.uint8), np.zeros(len(words))
            own[place] = np.asarray(seen.field("of").fill_null(0))
            own_logs[place] = np.log10(np.asarray(seen.field("n").fill_null(0)) + 1)
            own_known, bare = own > 0, np.flatnonzero(own == 0)
            own[bare] = speller.classes(words.take(pa.array(bare)).to_pylist())

            numbers = batch.column(2).to_pylist()
            ids = np.frombuffer(b"".join(numbers), np.int32)
            ends = np.cumsum([len(x) // 4 for x in numbers])
            classes = np.empty(len(ids), np.uint8)
            sure, count = np.full(len(numbers), logs[0]), np.full(len(numbers), int(known[0]))
            for i in range(0, len(ids), _SLICE):
                part = ids[i : i + _SLICE]
                text = np.searchsorted(ends, np.arange(i, i + len(part)), side="right")
                inside = part < beyond
                mine = first[text[~inside]] + part[~inside] - beyond
                value, sort, is_known = np.empty(len(part)), classes[i : i + _SLICE], np.empty(len(part), bool)
                for column, common, other in ((value, logs, own_logs), (sort, of, own), (is_known, known, own_known)):
                    column[inside], column[~inside] = common[part[inside]], other[mine]
                sure += np.bincount(text, value, len(numbers))
                count += np.bincount(text[is_known], minlength=len(numbers))
            cut = [x.tobytes() for x in np.split(classes, ends[:-1])]
            arrays = [batch.column(0), batch.column(1), pa.array(cut, pa.binary()), pa.array(count), pa.array(sure)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "held", "classes", "known", "sure"])

    return run


def _score(moves: np.ndarray, spread: np.ndarray) -> Callable:
    """Tokens of each text and what transitions and the sizes of classes add to its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2):
            tokens, totals = [], []
            for text in batch.column(2).to_pylist():
                whole, total = _sequence([text], np.uint8), 0.0
                for i in range(0, len(whole) - 1, _SLICE):
                    part = whole[i : i + _SLICE + 1]
                    total += float(moves[part[:-1], part[1:]].sum() - spread[part[1:]].sum())
                tokens.append(len(whole) - 1)
                totals.append(total)
            arrays = [batch.column(i) for i in (0, 1, 3, 4)] + [pa.array(tokens, pa.int64()), pa.array(totals, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "held", "known", "sure", "tokens", "total"])

    return run


def _frequent(words: DataFrame, most: int):
    """A condition on word and n that at most ``most`` words of HEAD_BYTES meet: the upper bins of a histogram of counts, 32 a doubling.

    A threshold picks them where they are, so no task sorts or merges the vocabulary.
    """
    level, short = F.floor(F.log2("n") * 32).cast("int"), F.octet_length("word").between(1, HEAD_BYTES)
    counted = words.filter(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("m"))
    bins = sorted(((r["level"], r["m"]) for r in counted.collect()), reverse=True)
    least, held = None, 0
    for name, count in bins:
        held += count
        if held > most:
            break
        least = name
    return short & (level >= least) if least is not None else F.lit(False)


def class_words(training: DataFrame, vocabulary: DataFrame, common, words: list[bytes], counts: np.ndarray) -> tuple[DataFrame, Speller]:
    """word, n and class of the whole vocabulary, as a written table, and the speller for words that aren't in it.

    ``words`` are the head, the most frequent first, ``common`` the condition that tells them. The SEEDS first are clustered by
    exchange among themselves. Then PASSES times every word found LEAST times, in the head or not, takes the class of best
    likelihood by the classes of all its neighbours, and class bigrams are counted anew. Rarer words go by spelling.
    """
    spark, place = training.sparkSession, {w: i + 1 for i, w in enumerate(words)}
    seeds = min(SEEDS, len(words))
    ranks = np.minimum(np.arange(len(words) + 2), seeds + 1)
    first = exchange(_pair_table(training, "numbers", np.int32, ranks, seeds + 2))[1:-1]
    of = np.full(len(words) + 2, _OPEN, dtype=np.uint8)
    of[0], of[1 : seeds + 1] = 0, first
    keyed = vocabulary.withColumn("key", F.xxhash64("word"))
    found = keyed.filter(common).select("word", "key").toArrow()
    keys = np.zeros(len(words) + 1, dtype=np.int64)
    keys[[place[w] for w in found["word"].to_pylist()]] = np.asarray(found["key"])
    keys = spark.sparkContext.broadcast(keys)
    classes = None
    for _ in range(PASSES):
        classes = table(_best_classes(training, keys, of))
        rows = classes.mapInArrow(_among(keys), "key long, of int").toArrow().sort_by("key")
        met, met_of = np.asarray(rows["key"]), np.asarray(rows["of"])
        at = np.minimum(np.searchsorted(met, keys.value), max(0, len(met) - 1))
        same = np.flatnonzero(met[at] == keys.value) if len(met) else at[:0]
        of[same] = met_of[at[same]]
        of[0], of[1 : seeds + 1] = 0, first
    sure = np.flatnonzero(of[1:-1] != _OPEN)
    speller = Speller(spelling([words[i] for i in sure], counts[sure], of[1:-1][sure].astype(np.int64)))
    fixed = {END: 0, **dict(zip(words[:seeds], first.tolist()))}
    named = keyed.join(classes, "key", "left").select("word", "n", "of").mapInArrow(_name(fixed, speller), "word binary, n long, of int")
    return table(named), speller


def brown_scores(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row's whole text.

    Tokens are the A-Z-lower-cased words and one end. The model learns from rows whose crc32(doc_id) mod ``fold`` isn't
    ``held``. base_score adds log10((c + 1) / (N + V + 1)); score adds log10 of P(class | class before) P(word | class):
    transitions are smoothed towards class shares with weight PRIOR, emissions are (c + 1) / (N of the class + V of the
    class + 1), so that each class keeps room for a word never seen. A null or blank text is its end alone; a null
    doc_id learns and is scored as an empty id; repeated rows count each time; without training rows N is 0 and every
    token unknown; an empty table gives no row; other columns are ignored.

    Words, their neighbours and class bigrams are counted over the whole corpus. Exchange starts on the driver with the SEEDS
    most frequent words (a table of fixed size) and goes on in Spark with every word found LEAST times, of any length
    (``class_words``; words are told apart by 64-bit hashes there, so two of equal hash share a class). Texts are written once
    as numbers: those of the HEAD most frequent words are broadcast, the others of each text, once a word, meet count and class in a join.
    """
    spark = docs.sparkSession
    rows = docs.select(id_or_none().alias("_id"), binary_text(whole_text()).alias("t"), (crc_of_id() % fold == held).alias("held"))
    counted = rows.filter(~F.col("held")).select("_id", "t").mapInArrow(_count_words, "word binary, n long")
    vocabulary = table(counted.groupBy("word").agg(F.sum("n").alias("n")))
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, room = sums["n"], sums["n"] + sums["v"] + 1

    common = _frequent(vocabulary, HEAD)
    top = vocabulary.filter(common).toArrow()
    top = sorted(zip(top["word"].to_pylist(), top["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    words, counts = [w for w, _ in top], np.array([n for _, n in top], dtype=np.int64)
    schema = "_id long, held boolean, numbers binary, rest array<binary>"
    numbered = rows.select("_id", "t", "held").mapInArrow(_number(spark.sparkContext.broadcast({w: i + 1 for i, w in enumerate(words)})), schema)
    numbered = table(numbered.withColumn("uid", F.monotonically_increasing_id()))
    vocabulary, speller = class_words(numbered.filter(~F.col("held")), vocabulary, common, words, counts)

    size = 1 + 2 * CLASSES
    tokens, kinds, of = np.zeros(size), np.zeros(size), np.zeros(len(words) + 1, dtype=np.uint8)
    for row in vocabulary.groupBy("of").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).collect():
        tokens[row["of"]], kinds[row["of"]] = row["t"], row["k"]
    found = vocabulary.filter(common).select("word", "of").toArrow()
    of_word = dict(zip(found["word"].to_pylist(), found["of"].to_pylist()))
    of[1:] = [of_word[w] for w in words]
    seen = np.concatenate(([tokens[0]], counts))
    head = spark.sparkContext.broadcast((of, np.log10(seen + 1), seen > 0))

    others = numbered.select("uid", F.posexplode("rest").alias("pos", "word")).join(vocabulary, "word", "left")
    found = others.groupBy("uid").agg(F.collect_list(F.struct("pos", "n", "of")).alias("found"))
    texts = numbered.join(found, "uid", "left").select("_id", "held", "numbers", "rest", "found")
    classed = table(texts.mapInArrow(_class_texts(head, speller), "_id long, held boolean, classes binary, known long, sure double"))

    pairs = _pair_table(classed.filter(~F.col("held")), "classes", np.uint8, None, size)
    shares = (tokens + 1) / (tokens.sum() + size)
    moves = np.log10((pairs + PRIOR * shares) / (pairs.sum(1, keepdims=True) + PRIOR))
    spread = np.log10(tokens + kinds + 1)
    schema = "_id long, held boolean, known long, sure double, tokens long, total double"
    return classed.mapInArrow(_score(moves, spread), schema).select(
        as_id("_id").alias("doc_id"), F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("sure") - F.col("tokens") * F.lit(float(np.log10(room)))).alias("base_score"), (F.col("total") + F.col("sure")).alias("score"),
    )
