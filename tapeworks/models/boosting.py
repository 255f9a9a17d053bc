"""Gradient boosting of several heads at once over binned features, as sums over blocks of rows.

A fit sees its rows as blocks of bin numbers. Everything a tree needs from them is a sum over blocks: histograms of gradients
for each level, counts of residuals for quantile leaves. If the rows are more than one block, each sum is a Spark job that adds
blocks up in two steps and brings one bounded array to the driver; scores are written to the shared folder every few rounds, so no
lineage grows. If they are one block, there is nothing to add up, and one task goes through all rounds.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import BoostConfig
from ..runtime import written

BINS = 64  # of a feature; bin 0 holds the rows that lack it
RESIDUAL_BINS = 1024
BLOCK = 1 << 17  # rows of a block
FAN_IN = 16  # partial sums that reach the driver
CUT_EVERY = 20  # rounds after which scores are written
_CHUNK = 1 << 13
LEAST_CURVATURE, LEAST_GAIN = 1e-3, 1e-12
_BLOCK = "part int, bins binary, y binary, scores binary"


@dataclass(frozen=True)
class Objective:
    """``kind`` is quantile (y repeated for each head), softmax (one-hot y) or logistic (0/1 y for each head on its own)."""

    kind: str
    heads: int
    quantiles: tuple[float, ...] = ()

    def gradients(self, y: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Slope and curvature of the loss; no curvature stands for 1 everywhere."""
        if self.kind == "quantile":
            q = np.array(self.quantiles)[:, None]
            return np.where(y > scores, -q, 1 - q), None
        p = probabilities(self.kind, scores)
        return p - y, p * (1 - p)


def probabilities(kind: str, scores: np.ndarray) -> np.ndarray:
    if kind == "softmax":
        e = np.exp(scores - scores.max(axis=0))
        return e / e.sum(axis=0)
    return 1 / (1 + np.exp(-scores))


@dataclass
class Trees:
    """One tree for each head in heap order: children of node i are 2i + 1 and 2i + 2; a leaf has feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    unknown_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, heads: int, depth: int) -> Trees:
        shape = (heads, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape, bool), np.zeros(shape))

    def step(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows of each head one level down; those in leaves stay."""
        at = lambda a: np.take_along_axis(a, node, axis=1)
        feature = at(self.feature)
        x = bins[np.arange(bins.shape[0])[None, :], feature]
        left = np.where(x == 0, at(self.unknown_left), x <= at(self.bin))
        return np.where(feature < 0, node, 2 * node + 2 - left)

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros((len(self.feature), bins.shape[0]), dtype=np.int64)
        for _ in range(depth):
            node = self.step(bins, node)
        return node

    def scores(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.take_along_axis(self.value, self.leaves(bins, depth), axis=1)


def level_histogram(bins: np.ndarray, node: np.ndarray, wanted: np.ndarray, gradients: tuple[np.ndarray, np.ndarray | None]) -> np.ndarray:
    """Slope, curvature and rows of each (head, node of the level, feature, bin), for the wanted nodes."""
    (heads, width), features = wanted.shape, bins.shape[1]
    slope, curvature = gradients
    total = np.zeros((3, heads, width * features * BINS))
    columns = np.arange(features) * BINS
    for head in range(heads):
        slot = node[head] - (width - 1)
        rows = np.flatnonzero(np.where(slot >= 0, wanted[head][slot], False))
        for start in range(0, len(rows), _CHUNK):
            part = rows[start : start + _CHUNK]
            place = (bins[part] + (columns + (slot[part] * (features * BINS))[:, None])).ravel()
            total[0, head] += np.bincount(place, np.repeat(slope[head, part], features), total.shape[2])
            total[2, head] += np.bincount(place, minlength=total.shape[2])
            if curvature is not None:
                total[1, head] += np.bincount(place, np.repeat(curvature[head, part], features), total.shape[2])
    if curvature is None:
        total[1] = total[2]
    return total.reshape(3, heads, width, features, BINS)


def residual_counts(residual: np.ndarray, leaf: np.ndarray, nodes: int, edges: np.ndarray) -> np.ndarray:
    """Rows of each (head, node, bin of the residual)."""
    width, counts = edges.shape[1] + 1, []
    for head in range(len(leaf)):
        place = leaf[head] * width + np.searchsorted(edges[head], residual[head])
        counts.append(np.bincount(place, minlength=nodes * width).reshape(nodes, width))
    return np.stack(counts).astype(float)


def quantile_of_counts(counts: np.ndarray, edges: np.ndarray, q: float) -> np.ndarray:
    """The q-quantile of each row of counts, linear within its bin; 0 where there is nothing."""
    below = np.cumsum(counts, axis=1)
    want = q * below[:, -1]
    at = np.minimum((below < want[:, None]).sum(axis=1), len(edges))
    here = counts[np.arange(len(counts)), at]
    share = np.divide(want - (below[np.arange(len(counts)), at] - here), here, out=np.ones(len(counts)), where=here > 0)
    low, high = edges[np.clip(at - 1, 0, len(edges) - 1)], edges[np.clip(at, 0, len(edges) - 1)]
    return np.where(below[:, -1] > 0, low + share * (high - low), 0.0)


def split_level(trees: Trees, hist: np.ndarray, leaves: np.ndarray, config: BoostConfig) -> list[tuple[int, int, int]]:
    """Choose the best split of each node of a level, most gainful first while leaves are left.

    Gives (head, node, 0 or 1 for the child with fewer rows), nodes numbered within the level.
    """
    heads, width = hist.shape[1:3]
    head_of, node_of = np.nonzero(hist[2, :, :, 0, :].sum(axis=-1) >= max(1, 2 * config.min_rows_per_leaf))
    if not len(head_of):
        return []
    here = hist[:, head_of, node_of]  # slope, curvature, rows of (open node, feature, bin)
    sums = np.cumsum(here[..., 1:], axis=-1)[..., :-1]  # known rows up to each bin
    unknown, whole = here[..., :1], here[:, :, :1].sum(axis=-1, keepdims=True)
    sides = [sums, sums + unknown] if unknown.any() else [sums]
    with np.errstate(divide="ignore", invalid="ignore"):
        base = whole[0] ** 2 / whole[1]
        gains = []
        for left in sides:
            right = whole - left
            gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - base
            fits = (np.minimum(left[2], right[2]) >= config.min_rows_per_leaf) & (np.minimum(left[1], right[1]) >= LEAST_CURVATURE)
            gains.append(np.where(fits, gain, 0.0))
    flat = np.stack(gains, axis=1).reshape(len(head_of), -1)
    best = flat.argmax(axis=1)
    gain = flat[np.arange(len(flat)), best]
    side, feature, edge = np.unravel_index(best, (len(sides), *sums.shape[-2:]))
    done = []
    for i in np.argsort(-gain, kind="stable").tolist():
        head, k = int(head_of[i]), int(node_of[i])
        if gain[i] <= LEAST_GAIN or leaves[head] >= config.leaves:
            continue
        node = width - 1 + k
        f, b, s = feature[i], edge[i], side[i]
        trees.feature[head, node], trees.bin[head, node], trees.unknown_left[head, node] = f, b + 1, bool(s)
        left = sides[s][:, i, f, b]
        right = whole[:, i, 0, 0] - left
        for child, (g, h, _) in ((2 * node + 1, left), (2 * node + 2, right)):
            trees.value[head, child] = -g / max(h, LEAST_CURVATURE)
        leaves[head] += 1
        done.append((head, k, int(left[2] > right[2])))
    return done


def grow(objective: Objective, config: BoostConfig, histogram: Callable, counts: Callable, edges: np.ndarray | None) -> Trees:
    """One tree for each head. ``histogram(trees, level, wanted)`` and ``counts(trees)`` add up over all rows of the fit.

    Of two children only the one with fewer rows is counted; the other is what remains of their parent.
    """
    trees = Trees.empty(objective.heads, config.depth)
    leaves = np.ones(objective.heads)
    hist = histogram(trees, 0, np.ones((objective.heads, 1), dtype=bool))
    for level in range(1, config.depth + 1):
        splits = split_level(trees, hist, leaves, config)
        if not splits or level == config.depth:
            break
        wanted = np.zeros((objective.heads, 2**level), dtype=bool)
        for head, k, less in splits:
            wanted[head, 2 * k + less] = True
        parents, hist = hist, histogram(trees, level, wanted)
        for head, k, less in splits:
            hist[:, head, 2 * k + 1 - less] = parents[:, head, k] - hist[:, head, 2 * k + less]
    if objective.kind == "quantile":
        found = counts(trees)
        for head, q in enumerate(objective.quantiles):
            trees.value[head] = quantile_of_counts(found[head], edges[head], q)
    trees.value *= config.learning_rate
    return trees


def fit_block(bins: np.ndarray, y: np.ndarray, start: np.ndarray, objective: Objective, config: BoostConfig, edges: np.ndarray | None) -> list[Trees]:
    """All rounds over rows that are at hand."""
    scores, ensemble = np.repeat(start[:, None], bins.shape[0], axis=1), []
    for _ in range(config.rounds):
        gradients = objective.gradients(y, scores)
        node = np.zeros(scores.shape, dtype=np.int64)

        def histogram(trees: Trees, level: int, wanted: np.ndarray) -> np.ndarray:
            nonlocal node
            node = trees.step(bins, node) if level else node
            return level_histogram(bins, node, wanted, gradients)  # noqa: B023

        def counts(trees: Trees) -> np.ndarray:
            return residual_counts(y - scores, trees.leaves(bins, config.depth), trees.value.shape[1], edges)  # noqa: B023

        trees = grow(objective, config, histogram, counts, edges)
        scores = scores + trees.scores(bins, config.depth)
        ensemble.append(trees)
    return ensemble


def _bins_of(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of a matrix of features: 0 for an unknown value, then 1 + how many edges lie below it."""
    bins = np.empty(values.shape, dtype=np.uint8)
    for f, e in enumerate(edges):
        bins[:, f] = np.where(np.isnan(values[:, f]), 0, 1 + np.searchsorted(e, values[:, f]))
    return bins


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(pa.compute.fill_null(batch.column(n), np.nan), dtype=float) for n in names], axis=1)


def _packed(columns: list[str], targets: list[str], edges: list[np.ndarray], start: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y = _bins_of(_matrix(batch, columns), edges), _matrix(batch, targets).T
            scores = np.repeat(start[:, None], batch.num_rows, axis=1)
            blobs = (pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (bins, y, scores))
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(bins.tobytes()) % FAN_IN], pa.int32()), *blobs], names=["part", "bins", "y", "scores"])

    return run


def _unpacked(batch: pa.RecordBatch, features: int, heads: int) -> Iterator[tuple[np.ndarray, ...]]:
    for i in range(batch.num_rows):
        blob = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)  # noqa: B023, E731
        yield blob("bins", np.uint8).reshape(-1, features), blob("y", float).reshape(heads, -1), blob("scores", float).reshape(heads, -1)


def _sum_over_blocks(blocks: DataFrame, value: Callable, shape: tuple[int, ...], features: int, heads: int) -> np.ndarray:
    """The sum of an array over all blocks: within tasks, within FAN_IN groups of tasks, and on the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(shape), 0
        for batch in batches:
            for block in _unpacked(batch, features, heads):
                total += value(*block)
            part = batch.column("part")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for blob in batch.column("total"):
                total += np.frombuffer(blob.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    partials = blocks.mapInArrow(partial, "part int, total binary")
    rows = partials.repartition(FAN_IN, "part").mapInArrow(merged, "total binary").collect()
    return sum(np.frombuffer(r["total"]).reshape(shape) for r in rows)


def fit_blocks(blocks: DataFrame, features: int, objective: Objective, config: BoostConfig, edges: np.ndarray | None) -> list[Trees]:
    """The same over blocks that only Spark holds: one job for each level, and one for quantile leaves."""
    ensemble: list[Trees] = []
    pending: list[Trees] = []
    heads, depth = objective.heads, config.depth
    nodes = 2 ** (depth + 1) - 1

    def scored(bins: np.ndarray, scores: np.ndarray, trees: list[Trees]) -> np.ndarray:
        return scores + sum((t.scores(bins, depth) for t in trees), np.zeros_like(scores))

    for _ in range(config.rounds):
        if len(pending) == CUT_EVERY:
            done = list(pending)

            def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    new = [scored(bins, scores, done).tobytes() for bins, _, scores in _unpacked(batch, features, heads)]  # noqa: B023
                    yield batch.set_column(3, "scores", pa.array(new, pa.binary()))

            blocks, pending = written(blocks.mapInArrow(advance, _BLOCK)), []

        def histogram(trees: Trees, level: int, wanted: np.ndarray) -> np.ndarray:
            def value(bins, y, scores, before=tuple(pending)):
                node = np.zeros(scores.shape, dtype=np.int64)
                for _ in range(level):
                    node = trees.step(bins, node)
                return level_histogram(bins, node, wanted, objective.gradients(y, scored(bins, scores, before)))

            return _sum_over_blocks(blocks, value, (3, heads, 2**level, features, BINS), features, heads)  # noqa: B023

        def counts(trees: Trees) -> np.ndarray:
            def value(bins, y, scores, before=tuple(pending)):
                return residual_counts(y - scored(bins, scores, before), trees.leaves(bins, depth), nodes, edges)

            return _sum_over_blocks(blocks, value, (heads, nodes, edges.shape[1] + 1), features, heads)  # noqa: B023

        trees = grow(objective, config, histogram, counts, edges)
        ensemble.append(trees)
        pending.append(trees)
    return ensemble


@dataclass
class Boosted:
    """A fitted ensemble: a few hundred kilobytes, whatever it was trained on."""

    columns: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    ensemble: list[Trees]
    depth: int
    kind: str

    def scores(self, values: np.ndarray) -> np.ndarray:
        bins = _bins_of(values, self.edges)
        raw = np.repeat(self.start[:, None], len(values), axis=1)
        for trees in self.ensemble:
            raw = raw + trees.scores(bins, self.depth)
        return raw if self.kind == "quantile" else probabilities(self.kind, raw)

    def column(self) -> Column:
        """An array with one value for each head; one Arrow expression for any number of trees."""
        model = self

        @F.pandas_udf("array<double>")
        def boosted(*columns: pd.Series) -> pd.Series:
            values = np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)
            return pd.Series(list(model.scores(values).T))

        return boosted(*[F.col(c).cast("double") for c in self.columns])


def _start(rows: DataFrame, targets: list[str], objective: Objective) -> tuple[int, np.ndarray, np.ndarray | None]:
    """Rows, the first score of each head, and the edges of the bins of residuals."""
    shares = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(t).alias(t) for t in targets]).first()
    if objective.kind != "quantile":
        p = np.array([shares[t] for t in targets])
        return shares["n"], np.log(p) if objective.kind == "softmax" else np.log(p / (1 - p)), None
    probes = [(i + 0.5) / (RESIDUAL_BINS - 1) for i in range(RESIDUAL_BINS - 1)]
    found = np.array(rows.approxQuantile(targets[0], [0.0, *objective.quantiles, *probes, 1.0], 1e-4))
    start, marks = found[1 : 1 + objective.heads], np.concatenate((found[:1], found[1 + objective.heads :]))
    return shares["n"], start, marks[None, :] - start[:, None]


def boost(rows: DataFrame, columns: tuple[str, ...], targets: dict[str, Column], objective: Objective, config: BoostConfig) -> Boosted:
    """Fit one ensemble for each target. ``rows`` have a value for all targets; unknown features form a bin of their own.

    Bin edges are quantiles from a mergeable sketch. A feature without a known value takes no part. Rows travel as bytes, one
    for each feature.
    """
    names = list(targets)
    table = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], *[t.cast("double").alias(n) for n, t in targets.items()])
    found = table.approxQuantile(list(columns), [i / (BINS - 1) for i in range(1, BINS - 1)], 0.001)
    edges = {c: np.unique(q) for c, q in zip(columns, found) if q}
    if not edges:
        raise ValueError("no feature has a known value in the training rows")
    n, start, residual = _start(table, names, objective)
    known = list(edges)
    pack = _packed(known, names if objective.kind != "quantile" else names * objective.heads, list(edges.values()), start)
    blocks = table.select(*known, *names).mapInArrow(pack, _BLOCK)
    heads, features = objective.heads, len(known)
    if n > BLOCK:
        ensemble = fit_blocks(written(blocks), features, objective, config, residual)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [block for batch in batches for block in _unpacked(batch, features, heads)]
            if parts:
                bins, y, _ = (np.concatenate(a, axis=i) for a, i in zip(zip(*parts), (0, 1, 1)))
                order = np.lexsort((*y, *bins.T))  # the order of rows decides how sums round
                fitted = fit_block(bins[order], y[:, order], start, objective, config, residual)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted)], pa.binary())], names=["model"])

        ensemble = pickle.loads(blocks.repartition(1).mapInArrow(run, "model binary").first()[0])
    return Boosted(known, list(edges.values()), start, ensemble, config.depth, objective.kind)
