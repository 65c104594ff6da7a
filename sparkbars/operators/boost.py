"""Regression trees over pre-binned features: boosting (leaf-wise or to a depth)
and a forest, as estimators with the setters, ``fit`` and ``transform`` of MLlib's.

Every feature value becomes one byte, its bin between quantiles of a bounded
sample of rows. A node's histogram holds, per feature and bin, the sum of the
residuals and of the weights; the best split follows from prefix sums, and of
two children only the smaller one is summed, the other is the difference.

A table of up to LOCAL_CELLS bytes is trained in a task (a forest's trees in
several). A larger one is trained by passes over it: every task sums histograms
of the nodes of one level over its rows, they are shuffled by blocks of features
and each block's best splits come back, a few rows a node. Rows keep no state
between passes: the trees so far give their residuals and nodes again.

``HistClassifier`` is MLlib's ``GBTClassifier`` (two classes, log loss, bins, splits
and leaves by its rules) for many rows: blocks of binned rows, a byte a feature, are
kept with the sum of the trees but the last few, so a round costs the same however many
trees there are, and residuals are summed as whole numbers, so the trees do not depend on
how the rows are dealt.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_removed

#: Bins of a feature, and rows whose quantiles divide them, at most.
BINS, BIN_ROWS = 32, 10_000
#: Bytes of binned features that one task trains from.
LOCAL_CELLS = 64 << 20
#: Tasks that share a forest's trees.
FOREST_TASKS = 16
#: Of a pass: nodes whose histograms a task holds, and features of a block that is shuffled.
PASS_NODES, PASS_FEATURES = 32, 8
#: Of a histogram: rows and features summed at once (blocks that stay in a core's cache).
_ROWS, _FEATURES = 256, 256
#: Steps of four times the largest label from the mean, and what a row's weight counts in a packed sum.
_STEPS, _COUNT = float(1 << 23), float(1 << 38)
#: Of the classifier: steps of a residual of 1 (residuals are 4 at most, so a block's packed sums are exact), rows
#: and bytes of a block at most, rows of a task, rounds between new sums of the trees, and between their checkpoints.
_FINE, _BLOCK_ROWS, _BLOCK_BYTES, _TASK_ROWS, _NEW, _KEEP = float(1 << 20), 1 << 14, 8 << 20, 2_000_000, 4, 12
#: Seed of the rows that give the classifier's bins (what MLlib draws for its seed 42).
_SAMPLE_SEED = 444206279
#: Arrays that best_split fills again and again, of the last shape.
_SCRATCH: dict[tuple, tuple] = {}


@dataclass
class Tree:
    """Nodes in order of making; a node of feature -1 is a leaf."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in zip((self.feature, self.bin, self.left, self.right, self.value), (-1, 0, -1, -1, value)):
            column.append(x)
        return len(self.value) - 1

    def split(self, node: int, feature: int, at: int, left: float, right: float) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, at
        self.left[node], self.right[node] = self.add(left), self.add(right)
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins`` (rows by features)."""
        feature, at, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        while len(rows := np.flatnonzero(feature[node] >= 0)):
            n = node[rows]
            node[rows] = np.where(bins[rows, feature[n]] <= at[n], left[n], right[n])
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    left: float  # means of the residuals
    right: float
    mean: float


def edges(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Features by bins - 1 upper ends, ascending, infinite where a feature needs fewer:
    all midpoints of few distinct values, else midpoints near the quantiles."""
    out = np.full((x.shape[1], bins - 1), np.inf)
    for f, column in enumerate(np.sort(x, axis=0).T):
        new = np.flatnonzero(column[1:] > column[:-1]) + 1
        if len(new) >= bins:  # the distinct value that begins at or after each quantile
            new = np.unique(new[np.minimum(np.searchsorted(new, len(column) * np.arange(1, bins) / bins), len(new) - 1)])
        out[f, : len(new)] = (column[new - 1] + column[new]) / 2
    return out


def binned(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many ends of its feature lie below each value of ``x`` (rows by features)."""
    out = np.zeros((len(x), len(ends)), np.uint8)
    for f, (e, column) in enumerate(zip(ends, x.T)):
        out[:, f] = np.searchsorted(e, column)
    return out


def histogram(bins: np.ndarray, rows: np.ndarray, steps: np.ndarray, weight: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Adds to ``out`` (bins, 2, features) sums of weight * steps and of weight over ``rows``.

    Both come from one sum: weights are whole numbers below 16 and steps whole
    numbers up to _STEPS, so a block's sums are exact in a double, and apart."""
    n_bins, _, width = out.shape
    offset = n_bins * np.arange(min(width, _FEATURES))
    for lo in range(0, len(rows), _ROWS):
        block = rows[lo : lo + _ROWS]
        part, packed = bins[block], weight[block] * (_COUNT + steps[block])
        for f in range(0, width, _FEATURES):
            place = part[:, f : f + _FEATURES] + offset[: width - f]
            k = place.shape[1]
            sums = np.bincount(place.ravel(), np.repeat(packed, k), n_bins * k).reshape(k, n_bins)
            count = np.rint(sums / _COUNT)
            out[:, 1, f : f + k] += count.T
            out[:, 0, f : f + k] += (sums - count * _COUNT).T
    return out


def best_split(hist: np.ndarray, least: float, unit: float) -> Split:
    """Of a node: the split whose halves' squared sums over weights gain most,
    each half of ``least`` weight at least; the first feature and bin of equal ones."""
    n_bins, _, width = hist.shape
    if not width or not (n := float(hist[:, 1, 0].sum())):
        return Split(0.0, -1, 0, 0.0, 0.0, 0.0)
    if hist.shape not in _SCRATCH:
        _SCRATCH.clear()
        _SCRATCH[hist.shape] = np.empty_like(hist), np.empty((n_bins - 1, width)), np.empty((n_bins - 1, width))
    upto, gain, other = _SCRATCH[hist.shape]
    np.copyto(upto, hist)
    for b in range(1, n_bins):  # prefix sums, of whole numbers: exact
        upto[b] += upto[b - 1]
    (left, weight), t = (upto[:-1, 0], upto[:-1, 1]), float(upto[-1, 0, 0])
    np.multiply(weight, -t / n, out=gain)
    gain += left
    gain *= gain
    np.subtract(n, weight, out=other)
    few = np.minimum(weight, other) < least if least > 1 else None
    other *= weight
    other[other <= 0] = np.inf
    if few is not None:
        other[few] = np.inf
    gain /= other
    most = float(gain.max())
    f = int(np.argmax((gain == most).any(axis=0)))
    b = int(np.argmax(gain[:, f] == most))
    if not most * n > 1e-10 * max(t * t / n, 1.0):
        return Split(0.0, -1, 0, 0.0, 0.0, unit * t / n)
    s, w = float(left[b, f]), float(weight[b, f])
    return Split(most * n * unit * unit, f, b, unit * s / w, unit * (t - s) / (n - w), unit * t / n)


def grow(bins: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int, leaves: int | None, least: float, n_bins: int, unit: float) -> Tree:
    """A tree from rows held here, residuals in steps of ``unit``. With ``leaves``,
    the leaf that gains most is split next; otherwise all are, to ``depth``."""
    tree, steps, rows = Tree(), np.rint(residual / unit), np.flatnonzero(weight > 0)
    hist = histogram(bins, rows, steps, weight, np.zeros((n_bins, 2, bins.shape[1])))
    split = best_split(hist, least, unit)
    open_, spare = [(-split.gain, tree.add(split.mean), 0, split, rows, hist)], []
    n_leaves = 1
    while open_ and (leaves is None or n_leaves < leaves):
        _, node, level, split, rows, hist = heapq.heappop(open_) if leaves else open_.pop()
        if split.feature < 0:
            spare.append(hist)
            continue
        n_leaves += 1
        goes = bins[rows, split.feature] <= split.bin
        halves, nodes = (rows[goes], rows[~goes]), tree.split(node, split.feature, split.bin, split.left, split.right)
        if level + 1 >= depth:
            spare.append(hist)
            continue
        small = int(len(halves[1]) < len(halves[0]))
        mine = spare.pop() if spare else np.empty_like(hist)
        mine.fill(0.0)
        histogram(bins, halves[small], steps, weight, mine)
        hist -= mine  # now of the larger half
        for half, sums in ((small, mine), (1 - small, hist)):
            split = best_split(sums, least, unit)
            entry = (-split.gain, nodes[half], level + 1, split, halves[half], sums)
            heapq.heappush(open_, entry) if leaves else open_.append(entry)
    return tree


def grow_by_levels(find: Callable[[Tree, list[int]], dict[int, Split]], depth: int, leaves: int | None) -> Tree:
    """The same tree when histograms are sums of a pass: all splits of a level are
    found together, then the best ``leaves`` - 1 are taken in order of their gain."""
    whole, splits, level = Tree(), {}, [0]
    whole.add(0.0)
    for d in range(depth):
        found = find(whole, level)
        if d == 0 and found:
            whole.value[0] = found[0].mean
        splits |= {n: s for n, s in found.items() if s.feature >= 0}
        level = [child for n in level if n in splits for child in whole.split(n, splits[n].feature, splits[n].bin, splits[n].left, splits[n].right)]
        if not level:
            break
    if leaves is None:
        return whole
    tree, open_ = Tree(), []
    tree.add(whole.value[0])
    taken = {0: 0}
    open_ = [(-splits[0].gain, 0, 0)] if 0 in splits else []
    while open_ and len(taken) < 2 * leaves - 1:
        _, new, n = heapq.heappop(open_)
        s = splits[n]
        for child, at in zip((whole.left[n], whole.right[n]), tree.split(new, s.feature, s.bin, s.left, s.right)):
            taken[child] = at
            if child in splits:
                heapq.heappush(open_, (-splits[child].gain, at, child))
    return tree


def poisson(key: np.ndarray, tree: int) -> np.ndarray:
    """Weights of a bootstrap: how often a tree draws each row, by its key, at a mean of 1."""
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = (h >> np.uint64(11)).astype(float) / (1 << 53)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 15)]))
    return np.searchsorted(steps, u, side="right").astype(float)


_TREE = "tree int, feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>"


@dataclass
class HistTrees:
    """Estimator. ``rate``: step of boosting on squared loss from the mean, None
    for a forest of bootstrapped trees; ``leaves``: leaves of a tree, None for
    all to ``depth``; ``least``: rows of a leaf."""

    rounds: int
    depth: int
    rate: float | None = None
    leaves: int | None = None
    least: int = 1
    bins: int = BINS
    seed: int = 0
    local_cells: int = LOCAL_CELLS

    def __post_init__(self):
        self.features, self.label, self.prediction = "features", "label", "prediction"

    def setFeaturesCol(self, name: str) -> HistTrees:
        self.features = name
        return self

    def setLabelCol(self, name: str) -> HistTrees:
        self.label = name
        return self

    def setPredictionCol(self, name: str) -> HistTrees:
        self.prediction = name
        return self

    def fit(self, train: DataFrame) -> TreesModel:
        """Trains on the rows whose label is not null; without rows the model predicts 0."""
        rows = train.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y")).filter("y IS NOT NULL")
        ends = self._edges(rows)
        n_bins, width = self.bins, len(ends)

        def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, width)
                rows = [r.tobytes() for r in binned(x, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("y")], names=["b", "y"])

        table = rows.mapInArrow(to_bytes, "b binary, y double").withColumn("key", F.xxhash64("b", "y")).checkpoint(eager=True)
        n, mean = table.agg(F.count("*"), F.coalesce(F.avg("y"), F.lit(0.0))).first()
        base = float(mean) if self.rate is not None else 0.0
        unit = 4.0 * (table.agg(F.max(F.abs(F.col("y") - base))).first()[0] or 1.0) / _STEPS
        if n * max(width, 1) <= self.local_cells:
            trees = self._local(table, width, base, unit)
        else:
            trees = self._passes(table, width, base, unit)
        scale = self.rate if self.rate is not None else 1.0 / max(self.rounds, 1)
        return TreesModel(trees if n else [], ends, base, scale, self.features, self.prediction, n_bins)

    def _edges(self, rows: DataFrame) -> np.ndarray:
        sample, n_bins = rows.orderBy(F.xxhash64("x", "y")).limit(BIN_ROWS).select("x").repartition(1), self.bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1) for b in batches if b.num_rows]
            if parts:
                ends = edges(np.concatenate(parts), n_bins)
                yield pa.RecordBatch.from_arrays([pa.array([len(ends)]), pa.array([ends.ravel()], pa.list_(pa.float64()))], names=["width", "ends"])

        found = sample.mapInArrow(run, "width bigint, ends array<double>").first()
        return np.array(found["ends"]).reshape(found["width"], -1) if found else np.zeros((0, n_bins - 1))

    def _local(self, table: DataFrame, width: int, base: float, unit: float) -> list[Tree]:
        tasks = 1 if self.rate is not None else min(self.rounds, FOREST_TASKS)
        spec = dict(depth=self.depth, leaves=self.leaves, least=self.least, n_bins=self.bins, unit=unit)
        rounds, rate, seed = self.rounds, self.rate, self.seed

        def run(part: pa.Table) -> pa.Table:
            part = part.combine_chunks()
            rows = np.frombuffer(b"".join(part.column("b").to_pylist()), np.uint8).reshape(part.num_rows, width)
            y, key = np.asarray(part.column("y")), np.asarray(part.column("key"))
            order = np.lexsort((y, key))  # the same whatever order the rows came in
            bins, y, key = rows[order], y[order], key[order]
            task, score, out = part.column("task")[0].as_py(), np.full(len(y), base), []
            for t in range(task, rounds, tasks):
                weight = np.ones(len(y)) if rate is not None else poisson(key, seed * 1_000_003 + t)
                tree = grow(bins, y - score, weight, **spec)
                if rate is not None:
                    score += rate * tree.predict(bins)
                out.append((t, tree))
            return pa.table({"tree": pa.array([t for t, _ in out], pa.int32())} | {
                c: pa.array([getattr(tree, c) for _, tree in out], pa.list_(pa.float64() if c == "value" else pa.int32())) for c in ("feature", "bin", "left", "right", "value")})

        copies = table.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        found = copies.repartition(tasks, "task").groupBy("task").applyInArrow(run, _TREE).collect()
        return [Tree(*[list(r[c]) for c in ("feature", "bin", "left", "right", "value")]) for r in sorted(found, key=lambda r: r["tree"])]

    def _passes(self, table: DataFrame, width: int, base: float, unit: float) -> list[Tree]:
        trees: list[Tree] = []
        for t in range(self.rounds):
            done = list(trees) if self.rate is not None else []

            def find(tree: Tree, nodes: list[int]) -> dict[int, Split]:
                found = {}
                for lo in range(0, len(nodes), PASS_NODES):
                    found |= self._pass(table, width, base, unit, done, tree, nodes[lo : lo + PASS_NODES], t)
                return found

            trees.append(grow_by_levels(find, self.depth, self.leaves))
        return trees

    def _pass(self, table: DataFrame, width: int, base: float, unit: float, done: list[Tree], tree: Tree, nodes: list[int], t: int) -> dict[int, Split]:
        """Best splits of ``nodes`` of an unfinished tree, from one pass over the table."""
        n_bins, least, rate, seed = self.bins, self.least, self.rate, self.seed

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(nodes), n_bins, 2, width))
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    bins = np.frombuffer(b"".join(part.column("b").to_pylist()), np.uint8).reshape(part.num_rows, width)
                    y = np.asarray(part.column("y"))
                    score = base + (rate * sum(d.predict(bins) for d in done) if done else 0.0)
                    weight = np.ones(len(y)) if rate is not None else poisson(np.asarray(part.column("key")), seed * 1_000_003 + t)
                    at = tree.leaves(bins)
                    for i, node in enumerate(nodes):
                        histogram(bins, np.flatnonzero((at == node) & (weight > 0)), np.rint((y - score) / unit), weight, total[i])
            blocks = range(0, width, PASS_FEATURES)
            yield pa.RecordBatch.from_arrays([
                pa.array([f for f in blocks for _ in nodes], pa.int32()), pa.array([n for _ in blocks for n in nodes], pa.int32()),
                pa.array([total[i, :, :, f : f + PASS_FEATURES].ravel() for f in blocks for i in range(len(nodes))], pa.list_(pa.float64()))], names=["first", "node", "sums"])

        def best(part: pa.Table) -> pa.Table:
            first, out = part.column("first")[0].as_py(), []
            node = np.asarray(part.column("node"))
            parts = part.column("sums").combine_chunks()
            parts = np.asarray(parts.flatten()).reshape(len(node), n_bins, 2, -1)
            for n in nodes:
                s = best_split(parts[node == n].sum(axis=0), least, unit)
                out.append((n, s.gain, s.feature + first if s.feature >= 0 else -1, s.bin, s.left, s.right, s.mean))
            kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["node", "gain", "feature", "bin", "left", "right", "mean"])

        partial = table.mapInArrow(sums, "first int, node int, sums array<double>")
        found = partial.groupBy("first").applyInArrow(best, "node int, gain double, feature int, bin int, left double, right double, mean double")
        top_ = found.groupBy("node").agg(F.max_by(F.struct(*found.columns[1:]), F.struct("gain", -F.col("feature"))).alias("s")).collect()
        return {r["node"]: Split(*r["s"]) for r in top_}


@dataclass
class TreesModel:
    trees: list[Tree]
    ends: np.ndarray
    base: float
    scale: float
    features: str
    prediction: str
    n_bins: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.ends)
        return self.base + self.scale * sum((t.predict(bins) for t in self.trees), np.zeros(len(x)))

    def predict(self, features) -> float:
        return float(self.scores(np.asarray(features.toArray())[None, :])[0])

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        return df.withColumn(self.prediction, score(vector_to_array(self.features)))


def quantile_ends(x: np.ndarray, bins: int, expected: float) -> np.ndarray:
    """Like ``edges``, the ends by MLlib's rule: a midpoint goes where the count comes nearest to a multiple of the
    stride. ``expected`` rows are counted; those that no other value has count as zeros."""
    out = np.full((x.shape[1], max(bins - 1, 1)), np.inf)
    for f, column in enumerate(x.T):
        values, counts = np.unique(column[column != 0], return_counts=True)
        counts, zeros, stride = counts.astype(float), expected - counts.sum(), expected / bins
        if not len(values):
            continue
        if zeros > np.finfo(float).eps * counts.sum() * 100:
            at = np.searchsorted(values, 0.0)
            values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
        middle, upto = (values[:-1] + values[1:]) / 2, np.cumsum(counts)
        if len(middle) >= bins:
            target, taken = stride, []
            for i in range(len(middle)):
                if abs(upto[i] - target) < abs(upto[i + 1] - target):
                    taken.append(i)
                    target += stride
            middle = middle[taken]
        out[f, : len(middle)] = middle[: out.shape[1]]
    return out


def _residuals(y: np.ndarray, score: np.ndarray, t: int) -> np.ndarray:
    """What tree ``t`` is fitted to, in steps: the classes -1 and 1 at first, then the gradient of the log loss."""
    sign = 2.0 * y - 1.0
    if t:
        with np.errstate(over="ignore"):
            sign = 4.0 * sign / (1.0 + np.exp(2.0 * sign * score))
    return np.rint(sign * _FINE)


def _rows_of(tree: Tree, bins: np.ndarray) -> list[np.ndarray]:
    """Which rows come to each node, of ``bins`` features by rows."""
    at = [np.ones(bins.shape[1], bool)] * len(tree.value)
    for node, f in enumerate(tree.feature):
        if f >= 0:  # children come after their parent
            goes = bins[f] <= tree.bin[node]
            at[tree.left[node]], at[tree.right[node]] = at[node] & goes, at[node] > goes
    return at


def _raised(score: np.ndarray, bins: np.ndarray, trees: list[tuple[Tree, float]]) -> np.ndarray:
    """``score`` plus the trees' values times their weights, of ``bins`` features by rows."""
    for tree, weight in trees:
        node = np.zeros(len(score), np.uint8 if len(tree.value) <= 256 else np.int32)
        for leaf, rows in enumerate(_rows_of(tree, bins)):
            if leaf and tree.feature[leaf] < 0:
                node += rows * node.dtype.type(leaf)
        score = score + (weight * np.array(tree.value))[node]
    return score


class _Shown:
    """A tree as MLlib's models show theirs."""

    def __init__(self, tree: Tree, ends: np.ndarray):
        self.tree, self.ends = tree, ends

    @property
    def numNodes(self) -> int:
        return len(self.tree.value)

    @property
    def toDebugString(self) -> str:
        t, lines = self.tree, [f"Tree with {self.numNodes} nodes"]

        def show(node: int, indent: str) -> None:
            if (f := t.feature[node]) < 0:
                lines.append(f"{indent}Predict: {t.value[node]}")
                return
            for word, child, sign in (("If", t.left[node], "<="), ("Else", t.right[node], ">")):
                lines.append(f"{indent}{word} (feature {f} {sign} {self.ends[f][t.bin[node]]})")
                show(child, indent + " ")

        show(0, "  ")
        return "\n".join(lines)


class HistClassifier(Estimator, HasFeaturesCol, HasLabelCol):
    """Boosted trees for labels 0 and 1 by the log loss, with the rules of MLlib's ``GBTClassifier``.

    ``deal``: of many rows those that give the bins are drawn by their places in partitions; ``deal`` takes the training
    rows to a frame of their keys, each key once, dealt as the draw shall see them. Without it they are drawn as they lie."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", rounds: int = 20, depth: int = 5, rate: float = 0.1, least: int = 1, bins: int = BINS,
                 deal: Callable[[DataFrame], DataFrame] | None = None):
        super().__init__()
        self.deal = deal
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins

    def _fit(self, train: DataFrame) -> HistClassifierModel:
        rows = train.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit")
        ends = self._ends(train, min(self.bins, n), n)
        state = self._blocks(rows, ends, n)
        trees: list[Tree] = []
        kept = None  # the last checkpoint
        new: list[tuple[Tree, float]] = []  # not yet in the sums
        for t in range(self.rounds):
            old = None
            if len(new) == _NEW:
                old, state, new = state, state.map(_raiser(new)).persist(StorageLevel.MEMORY_AND_DISK), []
                if t % _KEEP == 0:
                    state.checkpoint()
            trees.append(self._tree(state, new, ends, t))
            new.append((trees[-1], self.rate if t else 1.0))
            if old:
                old.unpersist()
            if state.isCheckpointed() and (path := state.getCheckpointFile()) != kept:
                _forget(state, kept)  # a later one stands for it
                kept = path
        state.unpersist()
        _forget(state, kept)
        model = HistClassifierModel()._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol())
        return model._set(rate=self.rate, forest=json.dumps([[t.feature, t.bin, t.left, t.right, t.value] for t in trees]), ends=json.dumps(ends.tolist()))

    def _ends(self, train: DataFrame, bins: int, n: int) -> np.ndarray:
        """From the rows that MLlib's estimator with seed 42 samples: the same places in the same partitions."""
        spark, share = train.sparkSession, min(1.0, BIN_ROWS / n)

        def drawn(df: DataFrame) -> DataFrame:
            rows = df._jdf.toJavaRDD().sample(False, share, _SAMPLE_SEED)
            return DataFrame(spark._jsparkSession.createDataFrame(rows, df._jdf.schema()), spark)

        x = vector_to_array(self.getFeaturesCol()).alias("x")
        sample = train.select(x)
        if share < 1 and self.deal:
            keys = drawn(self.deal(train))
            keys = spark.createDataFrame(keys.collect(), keys.schema)  # about BIN_ROWS of them
            sample = train.join(F.broadcast(keys), keys.columns, "left_semi").select(x)
        elif share < 1:
            sample = drawn(sample)
        sample = sample.repartition(1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1) for b in batches if b.num_rows]
            if parts:
                ends = quantile_ends(np.concatenate(parts), bins, share * n)
                yield pa.RecordBatch.from_arrays([pa.array([len(ends)]), pa.array([ends.ravel()], pa.list_(pa.float64()))], names=["width", "ends"])

        found = sample.mapInArrow(run, "width bigint, ends array<double>").first()
        return np.array(found["ends"]).reshape(found["width"], max(bins - 1, 1))

    def _blocks(self, rows: DataFrame, ends: np.ndarray, n: int) -> RDD:
        """(labels, bins as features by rows, sums of the trees so far: zeros) of blocks of rows, dealt evenly and written once."""
        width = len(ends)
        most = max(1, min(_BLOCK_ROWS, _BLOCK_BYTES // max(width, 1)))

        def block(part: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            y, b = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            return pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(b.T).tobytes()], pa.binary())], names=["y", "b"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held = [], 0
            for batch in batches:
                for lo in range(0, batch.num_rows, most):
                    piece = batch.slice(lo, most)
                    x, y = np.asarray(piece.column("x").flatten()).reshape(piece.num_rows, width), piece.column("y").to_numpy(zero_copy_only=False)
                    if not np.isfinite(x).all():
                        raise ValueError("features must not be NaN or infinite")
                    if not ((y == 0) | (y == 1)).all():
                        raise ValueError("labels must be 0 or 1")
                    if held + len(y) > most:
                        yield block(part)
                        part, held = [], 0
                    part.append((y.astype(np.uint8), binned(x, ends)))
                    held += len(y)
            if part:
                yield block(part)

        sc = rows.sparkSession.sparkContext
        tasks = max(sc.defaultParallelism, -(-n // _TASK_ROWS))
        with shuffles_removed(rows.sparkSession):
            blocks = rows.mapInArrow(run, "y binary, b binary").repartition(tasks).checkpoint(eager=True)

        def opened(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            y = np.frombuffer(r["y"], np.uint8)
            return y, np.frombuffer(r["b"], np.uint8).reshape(width, len(y)), np.zeros(len(y))

        return blocks.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)

    def _tree(self, state: RDD, new: list[tuple[Tree, float]], ends: np.ndarray, t: int) -> Tree:
        """By levels; of two children the smaller one is summed, the other is the difference."""
        tree, unit = Tree(), 1.0 / _FINE
        tree.add(0.0)
        whole = self._sums(state, new, tree, [0], ends, t)[0]
        tree.value[0] = float(whole[:, 0, 0].sum() / whole[:, 1, 0].sum() * unit) if len(ends) else 0.0
        level = [(0, whole)]
        for d in range(self.depth):
            pairs = []
            for node, hist in level:
                s = best_split(hist, self.least, unit)
                if s.feature >= 0:
                    halves, left = tree.split(node, s.feature, s.bin, s.left, s.right), hist[: s.bin + 1, 1, s.feature].sum()
                    pairs.append((halves if 2 * left <= hist[:, 1, s.feature].sum() else halves[::-1], hist))
            if d + 1 == self.depth or not pairs:
                break
            small = self._sums(state, new, tree, [p[0][0] for p in pairs], ends, t)
            level = sorted(((node, h) for (halves, hist), mine in zip(pairs, small) for node, h in zip(halves, (mine, hist - mine))), key=lambda e: e[0])
        return tree

    def _sums(self, state: RDD, new: list[tuple[Tree, float]], tree: Tree, nodes: list[int], ends: np.ndarray, t: int) -> np.ndarray:
        """Nodes by bins by (residuals in steps, rows) by features, from one pass over the rows."""
        shape = len(nodes), ends.shape[1] + 1, 2, len(ends)
        split = np.isfinite(ends).any(axis=1)

        def run(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
            total = np.zeros(shape, np.int64)
            for y, bins, score in blocks:
                packed, found = _COUNT + _residuals(y, _raised(score, bins, new), t), _rows_of(tree, bins)
                for i, node in enumerate(nodes):
                    rows = np.flatnonzero(found[node]) if node else slice(None)
                    mine = packed[rows]
                    sums = np.zeros(shape[1::2])
                    sums[0, ~split] = mine.sum()
                    for f in np.flatnonzero(split):
                        sums[:, f] = np.bincount(bins[f][rows], mine, shape[1])
                    count = np.rint(sums / _COUNT)
                    total[i, :, 0] += (sums - count * _COUNT).astype(np.int64)
                    total[i, :, 1] += count.astype(np.int64)
            yield total

        return state.mapPartitions(run).reduce(np.add).astype(float)


def _forget(rdd: RDD, path: str | None) -> None:
    """Removes a checkpoint that nothing reads any more (Spark keeps all by default)."""
    if path:
        at = rdd.ctx._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(rdd.ctx._jsc.hadoopConfiguration()).delete(at, True)


def _raiser(trees: list[tuple[Tree, float]]) -> Callable[[tuple], tuple]:
    return lambda block: (block[0], block[1], _raised(block[2], block[1], trees))


class HistClassifierModel(Model, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction, probability and prediction like MLlib's model; can be saved in a pipeline."""

    forest = Param(Params._dummy(), "forest", "features, bins, children and values of each tree's nodes, as JSON", TypeConverters.toString)
    ends = Param(Params._dummy(), "ends", "upper ends of each feature's bins, as JSON", TypeConverters.toString)
    rate = Param(Params._dummy(), "rate", "weight of every tree but the first", TypeConverters.toFloat)

    def _trees(self) -> list[Tree]:
        return [Tree(*c) for c in json.loads(self.getOrDefault("forest"))]

    def _ends(self) -> np.ndarray:
        return np.array(json.loads(self.getOrDefault("ends")))

    @property
    def trees(self) -> list[_Shown]:
        ends = self._ends()
        return [_Shown(t, ends) for t in self._trees()]

    @property
    def treeWeights(self) -> list[float]:
        return [self.getOrDefault("rate") if t else 1.0 for t in range(len(self._trees()))]

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, ends, weights = self._trees(), self._ends(), self.treeWeights

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series(np.zeros(0))
            return pd.Series(_raised(np.zeros(len(x)), np.ascontiguousarray(binned(np.stack(x.to_numpy()), ends).T), list(zip(trees, weights))))

        m = F.col("_margin")
        p = 1.0 / (1.0 + F.exp(-2.0 * m))
        df = df.withColumn("_margin", margin(vector_to_array(self.getFeaturesCol())))
        return (df.withColumn("rawPrediction", array_to_vector(F.array(-m, m))).withColumn("probability", array_to_vector(F.array(1.0 - p, p)))
                .withColumn("prediction", (m > 0).cast("double")).drop("_margin"))

    def evaluateEachIteration(self, df: DataFrame) -> list[float]:
        """The mean log loss on ``df`` after each round."""
        trees, ends, weights = self._trees(), self._ends(), self.treeWeights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(ends)), np.asarray(batch.column("y"))
                bins, score, losses = np.ascontiguousarray(binned(x, ends).T), np.zeros(len(y)), []
                for each in zip(trees, weights):
                    score = _raised(score, bins, [each])
                    losses.append(float((2.0 * np.logaddexp(0.0, -2.0 * (2.0 * y - 1.0) * score)).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(trees)), pa.int32()), pa.array(losses, pa.float64()), pa.array([len(y)] * len(trees), pa.int64())], names=["t", "loss", "n"])

        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        found = rows.mapInArrow(run, "t int, loss double, n bigint").groupBy("t").agg((F.sum("loss") / F.sum("n")).alias("loss")).collect()
        return [r["loss"] for r in sorted(found, key=lambda r: r["t"])]
