"""Extremely randomised trees and histogram gradient boosting, which Spark's own
learners don't have, and a forest of many deep trees on few cells (RandomForest).

Rows of equal features are one cell: their number and the sums of y and y squared, which
is all that a tree can tell of them. Cells stay with the executors in blocks of numpy
arrays, unless they are few (LOCAL): then a forest's trees are grown side by side, each
whole in a task, and boosting, whose trees wait for each other, takes no jobs. Else a pass broadcasts the trees
as they stand, each task finds its rows' nodes and returns sums by node, and the driver,
which has sums of nodes and no rows, splits them. All trees of a forest grow together,
two passes a level; a boosted tree takes a pass a level. A round's predictions aren't
stored: blocks have those of every REBUILD-th round, and add the trees since."""

from __future__ import annotations

import base64
import functools
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from assocframe.runtime import materialise, release

#: Rows of a block; cells (trees, nodes and features) of one pass of a forest.
ROWS, CELLS = 1 << 12, 1 << 22
#: Numbers (cells times columns) up to which the cells are held in one place, and trees
#: that a task grows then.
LOCAL, GROUP = 1 << 20, 20
#: Bins of a feature; rounds after which predictions are made anew.
BINS, REBUILD = 255, 20
#: Bins of a forest's feature, as Spark's own has them.
FEW = 32


class Trees:
    """Trees as arrays by (tree, node): feature (-1: a leaf), threshold (at most it goes
    left), left child (the right one is next to it), value."""

    def __init__(self, n: int):
        self.feature, self.left = np.full((n, 1), -1, np.int32), np.zeros((n, 1), np.int32)
        self.threshold, self.value, self.size = np.zeros((n, 1)), np.zeros((n, 1)), np.ones(n, np.int64)

    def room(self, nodes: int) -> None:
        more = nodes - self.feature.shape[1]
        if more > 0:
            more += nodes
            for name, fill in (("feature", -1), ("left", 0), ("threshold", 0), ("value", 0)):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, np.full((len(a), more), fill, a.dtype)], axis=1))

    def split(self, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Split each (tree, node); the left children. Of one tree, in the order given."""
        nth = np.arange(len(tree)) - np.searchsorted(tree, tree)
        left = self.size[tree] + 2 * nth
        np.add.at(self.size, tree, 2)
        self.room(int(self.size.max()))
        self.feature[tree, node], self.threshold[tree, node], self.left[tree, node] = feature, threshold, left
        return left

    def nodes(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row of x in each tree; at: nodes on the way to it."""
        tree = np.arange(len(self.feature))
        at = np.zeros((len(x), len(self.feature)), np.int32) if at is None else at
        while True:
            f = self.feature[tree, at]
            if (f < 0).all():
                return at
            right = np.take_along_axis(x, np.maximum(f, 0), axis=1) > self.threshold[tree, at]
            at = np.where(f < 0, at, self.left[tree, at] + right)

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.feature)), self.nodes(x)]

    @staticmethod
    def joined(parts: list[Trees]) -> Trees:
        out = Trees(0)
        width = max((int(p.size.max(initial=1)) for p in parts), default=1)  # of nodes, not of the room for them
        for name, fill in (("feature", -1), ("left", 0), ("threshold", 0), ("value", 0)):
            a, k = np.full((sum(len(p.feature) for p in parts), width), fill, getattr(out, name).dtype), 0
            for p in parts:
                had = getattr(p, name)[:, :width]
                a[k : k + len(had), : had.shape[1]] = had
                k += len(had)
            setattr(out, name, a)
        out.size = np.concatenate([p.size for p in parts]) if parts else out.size
        return out


def _arrays(rows: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of cells: features, rows, sums of y and of y squared."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield _block(held)
            held = []
    if held:
        yield _block(held)


def _block(rows: list) -> tuple[np.ndarray, ...]:
    return tuple(np.array([r[k] for r in rows], float) for k in range(4))


def _told(blocks: RDD | list, state, of: Callable, plus: Callable):
    """of(block, state) of all blocks, put together by plus."""
    if isinstance(blocks, list):
        return functools.reduce(plus, (of(b, state) for b in blocks))
    sent = blocks.context.broadcast(state)
    out = blocks.map(lambda b: of(b, sent.value)).treeReduce(plus)
    sent.destroy()
    return out


def _slots(trees: Trees, open_: np.ndarray, x: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each row in each tree where its node is open."""
    slot = open_[np.arange(len(open_)), trees.nodes(x, at)]
    row, tree = np.nonzero(slot >= 0)
    return row, slot[row, tree]


def _placed(block: tuple | list, trees: Trees) -> tuple:
    """A block with its rows' nodes: a list keeps them from pass to pass, as trees only
    grow at their leaves."""
    if isinstance(block, tuple):
        return *block, None
    block[4] = trees.nodes(block[0], block[4])
    return tuple(block)


def _ranges(block: tuple, state: tuple) -> tuple:
    """By slot: rows, sums of y and y squared, and each feature's least and greatest value."""
    (x, *w, at), (trees, open_, n) = _placed(block, state[0]), state
    row, slot = _slots(trees, open_, x, at)
    sums = np.stack([np.bincount(slot, v[row], n) for v in w])
    low, high = np.full((n, x.shape[1]), np.inf), np.full((n, x.shape[1]), -np.inf)
    order = np.argsort(slot, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(slot[order]) > 0)) if len(order) else np.zeros(0, np.int64)
    if len(first):
        at = slot[order][first]
        low[at], high[at] = np.minimum.reduceat(x[row[order]], first), np.maximum.reduceat(x[row[order]], first)
    return sums, low, high


def _lefts(block: tuple, state: tuple) -> np.ndarray:
    """By slot and feature: rows and sum of y at most at the drawn threshold."""
    (x, many, y, _, at), (trees, open_, n, cut) = _placed(block, state[0]), state
    row, slot = _slots(trees, open_, x, at)
    out = np.zeros((2, n, x.shape[1]))
    for f in range(x.shape[1]):
        left = x[row, f] <= cut[slot, f]
        out[0, :, f], out[1, :, f] = (np.bincount(slot[left], v[row[left]], n) for v in (many, y))
    return out


def extra_trees(blocks: RDD | tuple, n: int, features: int, trees: int, least: int, seed: int, first: int = 0) -> Trees:
    """All features of a node get one threshold each, even between the node's least and
    greatest value, and the one that lowers the variance most splits it, if both sides
    have `least` rows. blocks: or all cells, as one block."""
    out, group, end = [], max(1, min(trees, CELLS // (features * min(n, ROWS)))), first + trees
    whole = blocks if isinstance(blocks, tuple) else None
    for first in range(first, end, group):
        t = Trees(min(group, end - first))
        blocks = [[*whole, None]] if whole else blocks
        rng = np.random.default_rng([seed, first])
        tree, node = np.arange(len(t.feature)), np.zeros(len(t.feature), np.int64)
        while len(tree):
            open_ = np.full(t.feature.shape, -1, np.int64)
            open_[tree, node] = np.arange(len(tree))
            (count, total, square), low, high = _told(blocks, (t, open_, len(tree)), _ranges, lambda a, b: (a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])))
            t.value[tree, node] = total / count
            spread = square / count - (total / count) ** 2
            go = (count >= 2 * least) & (spread > 1e-12 * np.maximum(square / count, 1e-300)) & (high > low).any(axis=1)
            drawn = low + rng.random(low.shape) * (high - low)
            tree, node, count, total, low, high, cut = (v[go] for v in (tree, node, count, total, low, high, drawn))
            if not len(tree):
                break
            open_ = np.full(t.feature.shape, -1, np.int64)
            open_[tree, node] = np.arange(len(tree))
            k, s = _told(blocks, (t, open_, len(tree), cut), _lefts, np.add)
            fits = (k >= least) & (count[:, None] - k >= least) & (high > low)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(fits, s**2 / k + (total[:, None] - s) ** 2 / (count[:, None] - k), -np.inf)
            top = score.max(axis=1)
            best = (score >= (top - 1e-9 * np.abs(top))[:, None]).argmax(axis=1)  # the first of equal ones, whatever the order of the sums
            go = np.isfinite(top)
            tree, node, best, cut = tree[go], node[go], best[go], cut[go]
            left = t.split(tree, node, best, cut[np.arange(len(best)), best])
            tree, node = np.repeat(tree, 2), np.stack([left, left + 1], axis=1).ravel()
        out.append(t)
    return Trees.joined(out)


def _binned(block: tuple, cuts: list[np.ndarray], start: float, done: Trees) -> tuple[np.ndarray, ...]:
    x, n, y, _ = block
    b = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
    b, at = np.unique(b, axis=0, return_inverse=True)
    n, y = (np.bincount(at.ravel(), v, len(b)) for v in (n, y))
    return b, n, y, start + done.values(b.astype(float)).sum(axis=1)


def _histograms(block: tuple, state: tuple) -> np.ndarray:
    """By slot, feature and bin: rows and sum of residuals."""
    (b, many, y, before), (since, tree, open_, n) = block, state
    rest = y - many * (before + since.values(b.astype(float)).sum(axis=1))
    row, slot = _slots(tree, open_, b.astype(float))
    out = np.zeros((2, n, b.shape[1], BINS + 1))
    for f in range(b.shape[1]):
        key = slot * (BINS + 1) + b[row, f]
        out[0, :, f], out[1, :, f] = (np.bincount(key, w, n * (BINS + 1)).reshape(n, -1) for w in (many[row], rest[row]))
    return out


def _best_splits(h: np.ndarray, least: int, l2: float) -> tuple[np.ndarray, ...]:
    """Per slot: rows, sum, and the split of the greatest gain: gain, feature, bin."""
    k, s = np.cumsum(h, axis=3)
    n, total = k[:, :1, -1:], s[:, :1, -1:]
    gain = np.where((k >= least) & (n - k >= least), s**2 / (k + l2) + (total - s) ** 2 / (n - k + l2) - total**2 / (n + l2), -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return n[:, 0, 0], total[:, 0, 0], flat[np.arange(len(at)), at], at // gain.shape[2], at % gain.shape[2]


def _grown(blocks: RDD, since: Trees, leaves: int, least: int, l2: float, rate: float) -> Trees:
    """One tree, the leaf of the greatest gain first, up to so many leaves. A pass looks
    at the children of all leaves at once, so passes are as many as levels."""
    t = Trees(1)
    info: dict[int, tuple] = {}

    def look(nodes: list[int]) -> None:
        open_ = np.full(t.feature.shape, -1, np.int64)
        open_[0, nodes] = np.arange(len(nodes))
        found = _best_splits(_told(blocks, (since, t, open_, len(nodes)), _histograms, np.add), least, l2)
        info.update({v: tuple(c[i] for c in found) for i, v in enumerate(nodes)})

    look([0])
    taken, children = [0], {}
    kept: set[int] = set()
    while True:
        while len(taken) < leaves:
            gains = {v: info[v][2] for v in taken}
            v = max(gains, key=lambda v: (gains[v], -v))
            if not gains[v] > 1e-12 or v not in children:
                break
            taken.remove(v)
            taken += [children[v], children[v] + 1]
            kept.add(v)
        more = [v for v in taken if v not in children and info[v][2] > 1e-12]
        if len(taken) >= leaves or not more:
            break
        at = np.array(more)
        left = t.split(np.zeros(len(at), np.int64), at, np.array([info[v][3] for v in more]), np.array([float(info[v][4]) for v in more]))
        children |= dict(zip(more, left.tolist(), strict=True))
        look([c for v in left.tolist() for c in (v, v + 1)])
    for v in children.keys() - kept:  # looked at, but not taken
        t.feature[0, v] = -1
    for v, (n, total, *_) in info.items():
        t.value[0, v] = rate * total / (n + l2)
    return t


def boosted(cells: DataFrame | tuple, cuts: list[np.ndarray], start: float, rounds: int, rate: float, leaves: int, least: int, l2: float) -> Trees:
    """Trees on bins: a row goes left where its bin is at most the threshold. cells: a
    table, or all as one block."""
    done, since, blocks, sent, local = Trees(0), [], None, None, isinstance(cells, tuple)
    for r in range(rounds):
        if r % REBUILD == 0:
            done, old, told = Trees.joined([done, *since]) if since else done, blocks, sent
            since = []
            if local:
                blocks = [_binned(cells, cuts, start, done)]
            else:
                sent = cells.sparkSession.sparkContext.broadcast(done)
                blocks = cells.rdd.mapPartitions(_arrays).map(lambda b, model=sent: _binned(b, cuts, start, model.value)).persist(StorageLevel.MEMORY_AND_DISK)
                blocks.count()
            if told is not None:
                old.unpersist()
                told.destroy()
        t = _grown(blocks, Trees.joined(since), leaves, least, l2, rate)
        since.append(t)
        if t.feature[0, 0] < 0:
            break
    if not local:
        blocks.unpersist()
        sent.destroy()
    return Trees.joined([done, *since])


def _bytes(t: Trees) -> bytes:
    used, out = np.arange(t.feature.shape[1]) < t.size[:, None], io.BytesIO()
    np.savez_compressed(out, size=t.size, **{name: getattr(t, name)[used] for name in ("feature", "left", "threshold", "value")})
    return out.getvalue()


def _of_bytes(held: bytes) -> Trees:
    with np.load(io.BytesIO(held)) as found:
        t = Trees(len(found["size"]))
        t.size = found["size"]
        shape = len(t.size), int(t.size.max(initial=1))
        used = np.arange(shape[1]) < t.size[:, None]
        for name, fill in (("feature", -1), ("left", 0), ("threshold", 0), ("value", 0)):
            a = np.full(shape, fill, getattr(t, name).dtype)
            a[used] = found[name]
            setattr(t, name, a)
    return t


class Forest(Model, DefaultParamsWritable, DefaultParamsReadable):
    """Fitted trees. All that they have is params, so that they can be saved."""

    nodes = Param(Params._dummy(), "nodes", "arrays by node, tree after tree, as text", TypeConverters.toString)
    scale = Param(Params._dummy(), "scale", "start, and factor of the sum of values", TypeConverters.toListFloat)
    shares = Param(Params._dummy(), "shares", "each feature's share of the gains, if known", TypeConverters.toListFloat)

    def __init__(self, trees: Trees | None = None, start: float = 0.0, factor: float = 1.0, shares: list[float] | None = None):
        super().__init__()
        self._trees = trees or Trees(0)
        self._set(scale=[float(start), float(factor)], shares=shares or [])

    @property
    def featureImportances(self) -> DenseVector:  # Spark's name of it
        return Vectors.dense(self.getOrDefault("shares"))

    def write(self):
        """The arrays become text only to be saved."""
        self._set(nodes=base64.b64encode(_bytes(self.trees())).decode())
        return super().write()

    def trees(self) -> Trees:
        return _of_bytes(base64.b64decode(self.getOrDefault("nodes"))) if self.isSet("nodes") else self._trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        t, (start, factor) = self.trees(), self.getOrDefault("scale")

        @F.pandas_udf(DoubleType())
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(start + factor * t.values(np.stack(x.to_numpy())).sum(axis=1)) if len(x) else pd.Series(dtype=float)

        return dataset.withColumn("prediction", predict(vector_to_array("scaled")))


def _cells(dataset: DataFrame, label: str) -> tuple[DataFrame, DataFrame, DataFrame | tuple, int]:
    """The written rows, the written cells, and the cells: as one block if they are few,
    else in as many partitions as they fill blocks; and their number."""
    rows = materialise(dataset.select(vector_to_array("scaled").alias("x"), F.col(label).cast("double").alias("y")), "rows")
    written = materialise(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("z")), "cells")
    n = written.count()
    if n * (3 + (len(written.first().x) if n else 0)) > LOCAL:
        return rows, written, written.coalesce(max(1, -(-n // ROWS))), n
    return rows, written, _block(sorted(written.collect())), n


class ExtraTrees(Estimator):
    def __init__(self, label: str, trees: int = 500, least: int = 2, seed: int = 42):
        super().__init__()
        self.label, self.trees, self.least, self.seed = label, trees, least, seed

    def _fit(self, dataset: DataFrame) -> Forest:
        rows, written, cells, n = _cells(dataset, self.label)
        width, trees, least, seed = len(written.first().x), self.trees, self.least, self.seed
        if isinstance(cells, tuple):
            context = dataset.sparkSession.sparkContext
            sent = context.broadcast(cells)
            firsts = list(range(0, trees, GROUP))
            parts = context.parallelize(firsts, len(firsts)).map(lambda k: extra_trees(sent.value, n, width, min(GROUP, trees - k), least, seed, k)).collect()
            sent.destroy()
            found = Trees.joined(parts)
        else:
            blocks = cells.rdd.mapPartitions(_arrays).persist(StorageLevel.MEMORY_AND_DISK)
            found = extra_trees(blocks, n, width, trees, least, seed)
            blocks.unpersist()
        release(rows, written)
        return Forest(found, 0.0, 1 / trees)


class HistBoosting(Estimator):
    def __init__(self, label: str, rounds: int = 300, rate: float = 0.03, leaves: int = 15, least: int = 20, l2: float = 0.1):
        super().__init__()
        self.label, self.rounds, self.rate, self.leaves, self.least, self.l2 = label, rounds, rate, leaves, least, l2

    def _fit(self, dataset: DataFrame) -> Forest:
        rows, written, cells, _ = _cells(dataset, self.label)
        width, start = len(written.first().x), rows.agg(F.avg("y")).first()[0]
        at = F.array(*[F.lit((i + 0.5) / (BINS + 1)) for i in range(BINS + 1)])
        values = rows.agg(*[F.percentile_approx(F.get("x", F.lit(f)), at, F.lit(20 * BINS)).alias(f"v{f}") for f in range(width)]).first()
        cuts = [(u[1:] + u[:-1]) / 2 for u in (np.unique(v) for v in values)]
        t = boosted(cells, cuts, start, self.rounds, self.rate, self.leaves, self.least, self.l2)
        release(rows, written)
        for k, v in zip(*np.nonzero(t.feature >= 0), strict=True):  # from bins to values
            t.threshold[k, v] = cuts[t.feature[k, v]][int(t.threshold[k, v])]
        return Forest(t, start, 1.0)


def _draws(cuts: list[np.ndarray], mean: float, trees: int, seed: int) -> Callable:
    """Batches of equal rows (x, y, their number n, a hash h) to pieces: a group of trees,
    the cells of bins, and by tree and cell the rows drawn and their sums of y and y
    squared. A tree draws each row by Poisson's law, so n rows by that of mean n; what it
    draws follows from h, wherever the row is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            x = np.stack(rows["x"].to_numpy())
            code, at = np.unique(np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8), axis=0, return_inverse=True)
            drawn = np.stack([np.random.Generator(np.random.Philox(key=np.array([h, seed], np.uint64))).poisson(n, trees) for h, n in zip(rows["h"].to_numpy().view(np.uint64), rows["n"], strict=True)]).astype(float)
            order = np.argsort(at.ravel(), kind="stable")
            first, y = np.searchsorted(at.ravel()[order], np.arange(len(code))), (rows["y"].to_numpy(float) - mean)[order, None]
            sums = np.stack([np.add.reduceat(drawn[order] * v, first) for v in (1.0, y, y * y)])
            yield pd.DataFrame([(k, code.tobytes(), sums[:, :, k : k + GROUP].tobytes()) for k in range(0, trees, GROUP)], columns=["first", "code", "sums"])

    return run


def _split_forest(x: np.ndarray, sums: np.ndarray, least: int) -> tuple[Trees, np.ndarray]:
    """Trees of cells x (bins), of which each has its own numbers and sums (by cell and
    tree), grown together; and by tree and feature the gains."""
    t, gained = Trees(sums.shape[2]), np.zeros((sums.shape[2], x.shape[1]))
    tree, cell = np.nonzero(sums[0].T)
    w, node, open_ = sums[:, cell, tree], np.zeros(sums.shape[2], np.int64), np.arange(sums.shape[2])
    slot = tree
    while len(open_):
        count, total, square = (np.bincount(slot, v, len(open_)) for v in w)
        many = np.maximum(count, 1)
        t.value[open_, node] = total / many
        go = (count >= 2 * least) & (square / many - (total / many) ** 2 > 1e-12 * np.maximum(square / many, 1e-300))
        k, s = np.zeros((2, len(open_), x.shape[1], FEW))
        for f in range(x.shape[1]):
            at = slot * FEW + x[cell, f]
            k[:, f], s[:, f] = (np.cumsum(np.bincount(at, v, len(open_) * FEW).reshape(-1, FEW), axis=1) for v in w[:2])
        n, all_ = count[:, None, None], total[:, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((k >= least) & (n - k >= least), s**2 / k + (all_ - s) ** 2 / (n - k) - all_**2 / n, -np.inf).reshape(len(open_), -1)
        top = gain.max(axis=1)
        go &= top > 1e-12 * square
        best = (gain >= (top - 1e-9 * np.abs(top))[:, None]).argmax(axis=1)  # the first of equal ones, whatever the order of the sums
        feature, cut = best[go] // FEW, best[go] % FEW
        np.add.at(gained, (open_[go], feature), top[go])
        left = t.split(open_[go], node[go], feature, cut)
        on = go[slot]
        slot, cell, w = (np.cumsum(go) - 1)[slot[on]], cell[on], w[:, on]
        slot = 2 * slot + (x[cell, feature[slot]] > cut[slot])
        open_, node = np.repeat(open_[go], 2), np.stack([left, left + 1], axis=1).ravel()
    return t, gained


def _groups(width: int, least: int) -> Callable:
    """The pieces of a group of trees to the trees."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        codes = [np.frombuffer(c, np.uint8).reshape(-1, width) for c in rows["code"]]
        x, at = np.unique(np.concatenate(codes), axis=0, return_inverse=True)
        parts = [np.frombuffer(v).reshape(3, len(c), -1) for c, v in zip(codes, rows["sums"], strict=True)]
        sums = np.zeros((3, len(x), parts[0].shape[2]))
        np.add.at(sums, (slice(None), at.ravel()), np.concatenate(parts, axis=1))
        t, gained = _split_forest(x, sums, least)
        return pd.DataFrame([(rows["first"].iloc[0], _bytes(t), gained.tobytes())], columns=["first", "trees", "gained"])

    return run


class RandomForest(Estimator):
    """A forest by the rules of Spark's own: rows drawn by Poisson's law, all features at
    each node, splits between FEW bins. Spark's grows all trees together by passes over
    the rows, each of which shuffles every open node's histograms, so many deep trees take
    hundreds of megabytes a pass. Here tasks sum what each tree draws by cell of bins, and
    the trees, which ask for nothing else, grow side by side, whole in a task each. Where
    cells are many (LOCAL), Spark's own takes the rows."""

    def __init__(self, label: str, trees: int = 500, least: int = 2, seed: int = 42):
        super().__init__()
        self.label, self.trees, self.least, self.seed = label, trees, least, seed

    def getNumTrees(self) -> int:  # Spark's name of it
        return self.trees

    def _fit(self, dataset: DataFrame) -> Model:
        y = F.col(self.label).cast("double")
        rows = materialise(dataset.select(vector_to_array("scaled").alias("x"), y.alias("y")), "rows")
        width, mean = len(rows.first().x), rows.agg(F.avg("y")).first()[0]
        at = F.array(*[F.lit((i + 0.5) / FEW) for i in range(FEW)])
        values = rows.agg(*[F.percentile_approx(F.get("x", F.lit(f)), at, F.lit(20 * BINS)).alias(f"v{f}") for f in range(width)]).first()
        few = [rows.select(F.get("x", F.lit(f))).distinct().limit(FEW + 1).collect() for f in range(width)]
        cuts = [(u[1:] + u[:-1]) / 2 for u in (np.unique(v if len(d) > FEW else d) for v, d in zip(values, few, strict=True))]
        under = lambda f: lambda v: v < F.get("x", F.lit(f))
        bins = [F.size(F.filter(F.array(*[F.lit(float(v)) for v in c]).cast("array<double>"), under(f))) for f, c in enumerate(cuts)]
        most = LOCAL // (3 + width)
        if rows.select(F.array(*bins)).distinct().limit(most + 1).count() > most:
            release(rows)
            return RandomForestRegressor(featuresCol="scaled", labelCol=self.label, numTrees=self.trees, minInstancesPerNode=self.least, maxDepth=30, featureSubsetStrategy="all", seed=self.seed).fit(dataset)
        equal = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("x", "y"))
        pieces = equal.mapInPandas(_draws(cuts, mean, self.trees, self.seed), "first int, code binary, sums binary")
        parts = pieces.groupBy("first").applyInPandas(_groups(width, self.least), "first int, trees binary, gained binary").collect()
        release(rows)
        parts = sorted(parts)
        found = Trees.joined([_of_bytes(p.trees) for p in parts])
        gained = np.concatenate([np.frombuffer(p.gained).reshape(-1, width) for p in parts])
        on, table = found.feature >= 0, np.stack([np.pad(c, (0, FEW - len(c))) for c in cuts])
        found.threshold[on] = table[found.feature[on], found.threshold[on].astype(int)]  # from bins to values
        share = (gained / np.maximum(gained.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
        return Forest(found, mean, 1 / self.trees, (share / max(share.sum(), 1e-300)).tolist())
