"""A compressed full-text index over word sequences: depth-bounded suffix order, wavelet matrix, backward search of many patterns at once."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Level-wise wavelet tree: how often a code stands before a place, for many codes and places at once."""

    def __init__(self, codes: np.ndarray, kinds: int):
        self.levels = []
        for shift in range(max(1, (kinds - 1).bit_length()) - 1, -1, -1):
            ones = (codes >> shift & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.concatenate((packed, np.zeros(8 - len(packed) % 8, np.uint8))).view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int32)[:-1])).astype(np.int32)
            self.levels.append((shift, words, before, int(len(codes) - ones.sum())))
            codes = np.concatenate((codes[~ones], codes[ones]))
        self.starts = self._down(np.arange(kinds), np.zeros(kinds, dtype=np.int64))

    def _down(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, words, before, zeros in self.levels:
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = np.where(codes >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(codes, at) - self.starts[codes]


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and each key's rank among the distinct ones."""
    order = np.argsort(key, kind="stable")
    ranks = np.empty(len(key), dtype=np.int64)
    ranks[order] = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
    return order, ranks


def _from(ranks: np.ndarray, shift: int) -> np.ndarray:
    """The value ``shift`` places on; behind the end stands what the last place has."""
    return np.concatenate((ranks[shift:], np.full(min(shift, len(ranks)), ranks[-1])))


class FMIndex:
    """Finds the windows of ``depth`` words of a pattern in a set of texts.

    Texts are arrays of codes from 1 on; 0 parts them. Suffixes are sorted by their first ``depth`` words only, by doubling:
    intervals of patterns of up to that length are the same as in a whole suffix order, and so is each backward step.
    """

    def __init__(self, texts: list[np.ndarray], depth: int):
        self.depth = depth
        text = np.concatenate([x for t in texts for x in (t, [0])]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        kinds = int(text.max()) + 1
        bits = kinds.bit_length()
        size = min(max(1, 62 // bits), depth - 1)
        key = text
        for i in range(1, size):
            key = key << bits | _from(text, i)
        order, ranks = _dense(key)
        while 2 * size < depth:
            order, ranks = _dense(ranks * len(text) + _from(ranks, size))
            size *= 2
        # Two overlapping grams of ``size`` words make one of depth words, or of depth - 1.
        order, _ = _dense(ranks * len(text) + _from(ranks, depth - size))
        self.order = order
        later = np.minimum(order + depth - 1 - size, len(text) - 1)
        fresh = np.concatenate(([True], (ranks[order[1:]] != ranks[order[:-1]]) | (ranks[later[1:]] != ranks[later[:-1]])))
        heads = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        self._low, self._high = heads[group], np.append(heads[1:], len(text))[group]
        self._less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=kinds))))[:-1]
        self._kinds, self._bwt = kinds, Wavelet(text[order - 1], kinds)

    def _step(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front; a code that no text has leaves none."""
        known = (codes > 0) & (codes < self._kinds)
        safe = np.where(known, codes, 0)
        both = self._bwt.rank(np.concatenate((safe, safe)), np.concatenate((low, high)))
        low, high = self._less[safe] + both[: len(low)], self._less[safe] + both[len(low) :]
        return low, np.where(known, high, low)

    def windows(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Pattern, start and interval of every window of ``depth`` words that some text has.

        The matching statistics, cut at depth: each pattern is read backwards. While windows match, the next one takes a
        single step: its interval is widened to that of its first depth - 1 words, whose extension by the word before is looked up.
        Where one does not match, the search starts anew one word on. All patterns move together.
        """
        depth = self.depth
        sizes = np.array([len(p) for p in patterns], dtype=np.int64)
        flat = np.concatenate([*patterns, [0]]).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        lane = np.flatnonzero(sizes >= depth)
        at = sizes[lane] - depth
        found = [tuple(np.zeros(0, dtype=np.int64) for _ in range(4))]
        while len(lane):
            low, high = np.zeros(len(lane), dtype=np.int64), np.full(len(lane), len(self.order))
            alive = np.arange(len(lane))
            for i in range(1, depth + 1):
                codes = flat[begins[lane[alive]] + at[alive] + depth - i]
                low, high = self._step(codes, low, high)
                some = high > low
                alive, low, high = alive[some], low[some], high[some]
            place = at.copy()  # the window that each lane looked at last
            now = at[alive]
            while len(alive):
                found.append((lane[alive], now, low, high))
                more = now > 0
                place[alive] = now
                place[alive[~more]] = 0
                alive, now, low = alive[more], now[more] - 1, low[more]
                low, high = self._step(flat[begins[lane[alive]] + now], self._low[low], self._high[low])
                place[alive] = now
                some = high > low
                alive, now, low, high = alive[some], now[some], low[some], high[some]
            again = place > 0
            lane, at = lane[again], place[again] - 1
        return tuple(np.concatenate(c) for c in zip(*found))

    def least(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The least of its texts' values for each interval of windows."""
        if not len(low):
            return np.zeros(0, dtype=values.dtype)
        names, back = np.unique(low, return_inverse=True)
        ends = np.zeros(len(names), dtype=np.int64)
        ends[back] = high
        of = np.append(values[self.owner[self.order]], values.max())
        return np.minimum.reduceat(of, np.stack((names, ends), axis=1).ravel())[::2][back]
