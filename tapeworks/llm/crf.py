"""Language ID by a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import as_id, blocks, crc_of_id, id_or_none, whole_text, where

UNKNOWN = "und"
SAMPLE = 256  # labelled rows a language, in SALTS parts
SALTS = 16
SAMPLE_BYTES = 4096
PIECE = 24  # words of one text before the training chain switches to another
CHAIN = 96
ROUNDS = 30
SEGMENT = 256
MIN_SCORE = 0.5
_TRIPLES, _FOURS, _WORDS = 1 << 16, 1 << 17, 1 << 18
_ZERO = _TRIPLES + _FOURS + _WORDS
_POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64), dtype=np.uint64)
# All ASCII bytes but letters end a word; other bytes belong to it.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def word_features(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature cells of the words in a buffer that starts and ends with three blanks: two a byte, one a word; word starts.

    Bytes give their 3-gram and 4-gram, marked by the blanks around the word, so the outer ones are its prefixes and
    suffixes; the word itself is its lexicon feature. Cells of what doesn't belong to a word are _ZERO.
    """
    inside = raw != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    wide = raw.astype(np.uint32)
    triple = wide[:-3] << 16 | wide[1:-2] << 8 | wide[2:-1]
    four = (triple << np.uint32(8)) | wide[3:]
    cells = np.full((2, len(raw)), _ZERO, dtype=np.int32)
    body = inside[1:-2]
    cells[0, 1:-2] = np.where(body, triple * np.uint32(2654435761) >> np.uint32(16), _ZERO)
    cells[1, 1:-2] = np.where(body & inside[2:-1], _TRIPLES + (four * np.uint32(2246822519) >> np.uint32(15)), _ZERO)
    if not len(starts):
        return cells, starts, starts
    letters = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
    place = np.minimum(np.arange(len(letters)) - np.repeat(first, ends - starts), len(_POWERS) - 1)
    sums = np.add.reduceat(raw[letters] * _POWERS[place], first)
    words = (sums ^ sums >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)
    return cells, (_TRIPLES + _FOURS + words.astype(np.int64)), starts


def buffer_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of letters and blanks, and where each text starts in it."""
    raw = b"   " + b"   ".join(t.translate(_LETTERS) for t in texts) + b"   "
    starts = 3 + np.concatenate(([0], np.cumsum([len(t) + 3 for t in texts])[:-1])).astype(np.int64)
    return np.frombuffer(raw, np.uint8), starts


def emissions(raw: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label scores of every word, and where the words start."""
    cells, words, starts = word_features(raw)
    if not len(starts):
        return np.zeros((0, weights.shape[1]), np.float32), starts
    by_byte = weights[cells[0]]
    by_byte += weights[cells[1]]
    return np.add.reduceat(by_byte, starts, axis=0) + weights[words], starts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _forward_backward(psi: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray, count_moves: bool = False):
    """Posteriors of chains in step; ``psi`` is chain x step x label, chains sorted by falling length.

    ``first`` is the distribution before each chain, ``last`` the backward message after it.
    """
    steps = psi.shape[1]
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains longer than each step
    forward = np.zeros_like(psi)
    state = first
    for t in range(steps):
        state = _unit((state[: alive[t]] @ moves) * psi[: alive[t], t])
        forward[: alive[t], t] = state
    expected = np.zeros_like(moves)
    message = last.copy()
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        into = _unit(message[:n]) * psi[:n, t]
        if count_moves:
            before = forward[:n, t - 1] if t else first[:n]
            z = ((before @ moves) * into).sum(axis=1)
            expected += moves * (before.T @ (into / z[:, None]))
        forward[:n, t] = _unit(forward[:n, t] * _unit(message[:n]))
        message[:n] = into @ moves.T
    return forward, expected


class Tagger:
    """Labels, feature weights and transition scores of a trained field."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.weights, self.moves = labels, weights, moves

    def judge(self, texts: list[bytes]) -> np.ndarray:
        """Mean posterior of each label over the words of each text; zeros for a text without words."""
        return self.means(texts)[0]

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What ``judge`` gives, and the mean over the words of each text of their largest posterior."""
        k = len(self.labels)
        raw, begins = buffer_of(texts)
        scores, starts = emissions(raw, self.weights)
        owner = np.searchsorted(begins, starts, side="right") - 1
        words = np.bincount(owner, minlength=len(texts))
        result, sure = np.zeros((len(texts), k)), np.zeros(len(texts))
        if not len(starts):
            return result, sure
        psi = np.exp(scores.astype(np.float64) - scores.max(axis=1, keepdims=True))
        psi = np.maximum(psi, 1e-30)
        parts = -(-words // SEGMENT)
        text_of = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        origin = (np.cumsum(words) - words)[text_of] + number * SEGMENT
        lengths = np.minimum(SEGMENT, words[text_of] - number * SEGMENT)
        order = np.argsort(-lengths, kind="stable")
        text_of, number, origin, lengths = text_of[order], number[order], origin[order], lengths[order]
        chains = np.ones((len(order), int(lengths.max()), k))
        row = np.repeat(np.arange(len(order)), lengths)
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chains[row, step] = psi[origin[row] + step]
        moves = np.exp(self.moves)
        first, last = self._bounds(chains, lengths, text_of, number, parts, moves)
        posterior, _ = _forward_backward(chains, lengths, moves, first, last)
        each = posterior[row, step]
        np.add.at(result, text_of[row], each)
        sure += np.bincount(text_of[row], each.max(axis=1), len(texts))
        return result / np.maximum(words, 1)[:, None], sure / np.maximum(words, 1)

    @staticmethod
    def _bounds(chains, lengths, text_of, number, parts, moves) -> tuple[np.ndarray, np.ndarray]:
        """What each segment gets from those before and after it, so that cutting a long text changes nothing."""
        count, steps, k = chains.shape
        first, last = np.full((count, k), 1.0 / k), np.full((count, k), 1.0 / k)
        if parts.max() == 1:
            return first, last
        product = np.broadcast_to(np.eye(k), (count, k, k)).copy()
        alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
        for t in range(steps):
            n = alive[t]
            product[:n] = (product[:n] @ moves) * chains[:n, None, t]
            product[:n] /= product[:n].sum(axis=(1, 2), keepdims=True)
        by_number = np.lexsort((text_of, number))
        at = {}
        for i in by_number:
            at[(int(text_of[i]), int(number[i]))] = i
        for i in by_number:
            if number[i]:
                j = at[(int(text_of[i]), int(number[i]) - 1)]
                first[i] = _unit(first[j] @ product[j])
        for i in by_number[::-1]:
            if number[i] + 1 < parts[text_of[i]]:
                j = at[(int(text_of[i]), int(number[i]) + 1)]
                last[i] = _unit(product[j] @ last[j])
        return first, last


def fit_tagger(texts: list[bytes], langs: list[str], rounds: int = ROUNDS, seed: int = 1) -> Tagger:
    """Train on words labelled with their text's language, in chains that switch texts every PIECE words.

    Gradients of the chains' log-likelihood come from forward-backward; steps are scaled by each weight's past gradients.
    """
    labels = sorted(set(langs))
    k = len(labels)
    raw, begins = buffer_of(texts)
    cells, words, starts = word_features(raw)
    owner = np.searchsorted(begins, starts, side="right") - 1
    truth = np.array([labels.index(x) for x in langs])[owner] if len(starts) else np.zeros(0, int)
    weights, moves = np.zeros((_ZERO + 1, k), np.float32), np.zeros((k, k))
    if k < 2 or not len(starts):
        return Tagger(labels, weights, moves)
    within = np.arange(len(owner)) - np.searchsorted(owner, owner)
    piece = owner.astype(np.int64) * (1 << 32) + within // PIECE
    _, piece_start, piece_size = np.unique(piece, return_index=True, return_counts=True)
    shuffled = np.random.default_rng(seed).permutation(len(piece_start))
    order = np.concatenate([np.arange(piece_start[i], piece_start[i] + piece_size[i]) for i in shuffled])
    order = order[: max(1, len(order) // CHAIN) * CHAIN]
    length = min(CHAIN, len(order))
    shape = (len(order) // length, length)
    target = truth[order].reshape(shape)
    one_hot = np.eye(k)[target]
    seen = np.zeros((k, k))
    np.add.at(seen, (target[:, :-1].ravel(), target[:, 1:].ravel()), 1)
    span = np.diff(np.append(starts, len(raw)))
    word_of = np.repeat(np.arange(len(starts)), span)
    flat = [(c[starts[0] :], word_of) for c in cells] + [(words, np.arange(len(words)))]
    past, past_moves = np.full(weights.shape, 1e-6), np.full((k, k), 1e-6)
    for _ in range(rounds):
        scores = np.zeros((len(starts), k))
        for c, w in flat:
            scores += np.stack([np.bincount(w, weights[c, j], len(starts)) for j in range(k)], axis=1)
        psi = np.exp(scores - scores.max(axis=1, keepdims=True))[order].reshape(*shape, k)
        psi = np.maximum(psi, 1e-30)
        even = np.full((shape[0], k), 1.0 / k)
        posterior, expected = _forward_backward(psi, np.full(shape[0], length), np.exp(moves), even, even, True)
        pull = np.zeros((len(starts), k))
        pull[order] = (one_hot - posterior).reshape(-1, k)
        slope = np.zeros(weights.shape)
        for c, w in flat:
            slope += np.stack([np.bincount(c, pull[w, j], len(weights)) for j in range(k)], axis=1)
        slope -= 0.05 * weights
        slope[_ZERO] = 0
        past += slope**2
        weights += (0.2 * slope / np.sqrt(past)).astype(np.float32)
        rise = seen + 1 - expected
        past_moves += rise**2
        moves += 0.2 * rise / np.sqrt(past_moves)
    return Tagger(labels, weights, moves)


def _excerpt() -> Column:
    """The text ``t``, or of one over SAMPLE_BYTES a run of words of about so many from a place hashed from the id.

    Where that run has no letter, it is the one from the text's first letter on.
    """
    size, chars = F.octet_length("t"), F.char_length("t")
    most = F.floor(chars * F.lit(SAMPLE_BYTES) / size).cast("int")
    start = F.pmod(F.xxhash64("doc_id", F.lit(5)), (chars - most + 1).cast("long")).cast("int")
    inner = F.regexp_replace(F.substring("t", start + 1, most), r"^\S*\s+|\s+\S*$", "")
    first = F.regexp_replace(F.substring("t", F.regexp_instr("t", F.lit(r"\p{L}")), most), r"\s+\S*$", "")
    return F.when(size <= SAMPLE_BYTES, F.col("t")).when(inner.rlike(r"\p{L}"), inner).otherwise(first)


def labelled_sample(docs: DataFrame, fold: int = 5, held: int = 0) -> DataFrame:
    """text and lang of at most SAMPLE learnable rows a language, the least by a hash of the id; of long texts an excerpt."""
    rows = docs.select(F.col("doc_id"), F.lower(whole_text()).alias("t"), F.col("lang").cast("string").alias("l")).filter(
        F.col("l").isNotNull() & (crc_of_id() % fold != held) & F.col("t").rlike(r"\p{L}")
    )
    rows = rows.withColumn("t", _excerpt())
    key = F.xxhash64("doc_id", F.lit(3))
    part = Window.partitionBy("l", F.pmod(key, F.lit(SALTS))).orderBy(key, "t")
    return rows.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= SAMPLE // SALTS).select("t", "l")


def train(docs: DataFrame, fold: int = 5, held: int = 0) -> Tagger:
    found = labelled_sample(docs, fold, held).toArrow().sort_by([("l", "ascending"), ("t", "ascending")])
    return fit_tagger([t.encode() for t in found["t"].to_pylist()], found["l"].to_pylist())


def _judged(batch: pa.RecordBatch, column: int, tagger: Tagger) -> tuple[list[str], np.ndarray]:
    """Labels and scores of a column of lower-cased texts, null where there is no letter."""
    texts = batch.column(column).to_pylist()
    if not tagger.labels:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    shares = tagger.judge([t or b"" for t in texts])
    best = shares.argmax(axis=1)
    names = [UNKNOWN if t is None else tagger.labels[b] for t, b in zip(texts, best)]
    top = np.clip(shares[np.arange(len(best)), best], 0, 1)
    return names, np.where([t is None for t in texts], 0.0, top)


def _letters():
    lower = F.lower(whole_text())
    return F.when(lower.rlike(r"\p{L}"), F.encode(lower, "UTF-8")).alias("_letters")


def _limit(tagger: Tagger) -> int:
    return max(1 << 14, (1 << 22) // max(4, len(tagger.labels)))


def languages(docs: DataFrame, fold: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row's whole text.

    Learned from text and non-null lang of rows whose crc32(doc_id) mod ``fold`` isn't ``held``, at most SAMPLE of each
    language (a bounded sample; meant for tens of languages), of texts over SAMPLE_BYTES a run of words of that size. A text's words get posteriors by forward-backward over
    the whole text; lang_pred has the largest mean, which is the score (ties: the first by name). A null text or one
    without a letter, or any text when nothing can be learned, is ``und`` with score 0. Repeated rows are judged alike;
    an empty table gives no row; other columns are ignored.
    """
    tagger = train(docs, fold, held)
    limit = _limit(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1, limit):
            names, top = _judged(batch, 1, tagger)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(top, pa.float64())], names=["_id", "lang_pred", "score"])

    found = docs.select(id_or_none().alias("_id"), _letters()).mapInArrow(run, "_id long, lang_pred string, score double")
    return found.withColumn("doc_id", as_id("_id")).select("doc_id", (crc_of_id() % fold == held).alias("held_out"), "lang_pred", "score")


def in_a_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents whose words fit languages, one or several, with their own columns.

    A text goes if it is ``und``, or if the mean over its words of their largest posterior is below ``min_score``, or
    below twice the even share where that is less, so that more labels make it no stricter.
    """
    tagger = train(docs)
    least = min(min_score, 2 / max(1, len(tagger.labels)))

    def fits(texts: list[bytes | None]) -> np.ndarray:
        stay = np.array([t is not None and bool(tagger.labels) for t in texts])
        if tagger.labels:
            stay &= tagger.means([t or b"" for t in texts])[1] >= least - 1e-9
        return stay

    return where(docs, _letters(), fits, _limit(tagger))
