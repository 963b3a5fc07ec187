"""Boosted regression trees of ``pyspark.ml``, fitted from histograms that each task counts with NumPy.

``TableGBT`` is ``GBTRegressor`` with the same parameters, the same bins, trees and gains, and its fit is a
``GBTRegressionModel``.  Only the passes differ:

* the rows' bins are kept packed, several features to a 16-bit column (``Layout``), in blocks that a task counts column by column;
* of two sibling nodes only the smaller is counted, the other's histogram is the parent's less that;
* blocks and what the next tree should predict lie in files under ``spark.checkpoint.dir`` that tasks map into memory, so a pass moves no rows.

Storage that isn't mounted as a folder can't be mapped: there the fit is that of ``pyspark.ml``.  What travels is as large as the model: histograms of a level's nodes, added up over the tasks, and the trees.  Which rows and features a tree
draws depends on the seed and on the layout of the blocks, as it depends on the layout of the rows in ``pyspark.ml``.
"""

from __future__ import annotations

import contextlib
import gc
import heapq
import json
import operator
import os
import shutil
import time
import urllib.parse
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.session import shared_dir

#: Bits of a packed column; rows of a block, and bytes of its columns, at most; tasks whose histograms the driver adds up.
WIDTH, ROWS, BYTES, TASKS = 10, 1 << 16, 32 << 20, 32
#: Fewer training rows are fitted by ``pyspark.ml`` itself: what a pass costs whatever the rows is less there.
LEAST = 200_000
EPSILON = 2.0 ** -52


def thresholds(values: np.ndarray, n: float, bins: int) -> np.ndarray:
    """The splits that ``pyspark.ml`` puts between a feature's sampled ``values`` (those left out of ``n`` are 0): all midpoints, or ``bins - 1`` at about equal counts."""
    v, c = np.unique(values, return_counts=True)
    c = c.astype(float)
    if n - c.sum() > EPSILON * n * 100:
        at = np.searchsorted(v, 0.0)
        if at < len(v) and v[at] == 0:
            c[at] += n - c.sum()
        else:
            v, c = np.insert(v, at, 0.0), np.insert(c, at, n - c.sum())
    mid = (v[:-1] + v[1:]) / 2
    if len(mid) <= bins - 1:
        return mid
    stride, seen, out = n / bins, np.cumsum(c), []
    target = stride
    for i in range(1, len(v)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            out.append(mid[i - 1])
            target += stride
    return np.array(out)


@dataclass
class Layout:
    """Feature f's bin is the ``bits[f]`` bits from ``shift[f]`` of packed column ``col[f]``; a feature without splits has no place (column -1).

    ``classes`` lists the features of each number of bits; a histogram holds them in that order, 2^bits bins each."""

    splits: list[np.ndarray]
    col: np.ndarray = field(init=False)
    shift: np.ndarray = field(init=False)
    bits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        d = len(self.splits)
        self.bits = np.array([int(len(s)).bit_length() for s in self.splits], np.int64)
        self.col, self.shift = np.full(d, -1, np.int64), np.zeros(d, np.int64)
        self.width = max(WIDTH, int(self.bits.max(initial=0)))
        free: dict[int, list[int]] = {}
        self.n_cols = 0
        for f in np.argsort(-self.bits, kind="stable"):
            b = int(self.bits[f])
            if not b:
                break
            room = min((r for r, cols in free.items() if cols and r >= b), default=None)
            if room is None:
                room, at = self.width, self.n_cols
                self.n_cols += 1
            else:
                at = free[room].pop()
            self.col[f], self.shift[f] = at, self.width - room
            free.setdefault(room - b, []).append(at)
        self.classes = [(int(b), np.flatnonzero(self.bits == b)) for b in np.unique(self.bits[self.bits > 0])]
        self.n_bins = int(sum(len(f) << b for b, f in self.classes))

    def pack(self, n: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The packed columns of ``n`` rows with entries (rows, cols, values), others 0."""
        if not np.isfinite(values).all():
            raise ValueError("features must not be NaN or infinite")
        zero = np.array([np.searchsorted(s, 0.0) for s in self.splits], np.int64)
        has, empty = self.col >= 0, np.zeros(self.n_cols, np.int64)
        np.add.at(empty, self.col[has], (zero << self.shift)[has])
        out = np.repeat(empty.astype(np.uint16)[:, None], n, axis=1)
        order = np.argsort(cols.astype(np.uint16) if len(self.splits) <= 1 << 16 else cols, kind="stable")
        ends = np.flatnonzero(np.r_[np.diff(cols[order]) != 0, True]) + 1 if len(order) else []
        start = 0
        for end in ends:
            e = order[start:end]
            f, start = cols[e[0]], end
            if self.col[f] >= 0:
                # a value's bin is the number of splits below it
                shifted = (np.searchsorted(self.splits[f], values[e]) - zero[f]) << self.shift[f]
                out[self.col[f], rows[e]] += shifted.astype(np.uint16)  # modulo 2^16, so a bin below zero's goes back
        return out

    def bins_of(self, codes: np.ndarray, f: int, rows: np.ndarray) -> np.ndarray:
        return (codes[self.col[f]].take(rows) >> np.uint16(self.shift[f])) & np.uint16((1 << int(self.bits[f])) - 1)

    def unpacked(self, joint: np.ndarray) -> np.ndarray:
        """Histograms (..., n_bins) by feature from those of the packed columns (columns, ..., 2^width)."""
        parts = []
        for b, feats in self.classes:
            for f in feats:
                h = joint[self.col[f]]
                h = h.reshape(*h.shape[:-1], 1 << (self.width - b - int(self.shift[f])), 1 << b, 1 << int(self.shift[f]))
                parts.append(h.sum(axis=(-3, -1)))
        return np.concatenate(parts, axis=-1)


@dataclass
class Tree:
    """Nodes by number, the root 0; ``left`` -1: a leaf, its right sibling follows the left child.  ``stats``: rows, sum and sum of squares of what the node's rows should predict."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    stats: list[np.ndarray] = field(default_factory=lambda: [np.zeros(3)])

    def split(self, node: int, feature: int, at: int, gain: float, left: np.ndarray, right: np.ndarray) -> None:
        self.feature[node], self.bin[node], self.gain[node], self.left[node] = feature, at, gain, len(self.left)
        for s in (left, right):
            for x, v in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.gain, -1.0), (self.stats, s)):
                x.append(v)

    def prediction(self, node: int) -> float:
        n, s, _ = self.stats[node]
        return float(s / n) if n else 0.0

    def impurity(self, node: int) -> float:
        n, s, q = self.stats[node]
        return max(float(q / n - (s / n) ** 2), 0.0) if n else 0.0

    def rows_by_leaf(self, layout: Layout, codes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        todo = [(0, rows)]
        while todo:
            node, r = todo.pop()
            if self.left[node] < 0:
                yield node, r
                continue
            left = layout.bins_of(codes, self.feature[node], r) <= self.bin[node]
            todo += [(self.left[node] + 1, r[~left]), (self.left[node], r[left])]


@dataclass
class Block:
    """Rows of a block: packed columns and, from ``at`` of ``targets``, what the next tree should predict.  Both are in memory-mapped files."""

    number: int
    n: int
    file: str
    start: int
    targets: str
    at: int

    def codes(self, n_cols: int) -> np.ndarray:
        return np.memmap(self.file, np.uint16, "r", self.start, (n_cols, self.n)) if n_cols else np.empty((0, self.n), np.uint16)

    def target(self) -> np.ndarray:
        return np.array(np.memmap(self.targets, np.float64, "r", self.at, (self.n,)))


@dataclass
class Draw:
    """The rows that a tree is fitted on: each with probability ``rate``."""

    seed: int
    tree: int
    rate: float

    def rows(self, block: Block) -> np.ndarray:
        if self.rate >= 1:
            return np.arange(block.n)
        return np.flatnonzero(np.random.default_rng([self.seed & ((1 << 63) - 1), self.tree, block.number]).random(block.n, dtype=np.float32) < self.rate)


@dataclass
class Step:
    """A finished tree, by which the targets move on: to minus the gradient of the squared error."""

    tree: Tree
    draw: Draw
    weight: float
    first: bool

    def moved(self, layout: Layout, block: Block, codes: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The new targets of a block, and the stats of the tree's leaves in it."""
        out, stats, drawn = np.empty_like(g), np.zeros((len(self.tree.left), 3)), np.zeros(len(g), bool)
        drawn[self.draw.rows(block)] = True
        for node, r in self.tree.rows_by_leaf(layout, codes, np.arange(len(g))):
            own, value = g.take(r), 2 * self.weight * self.tree.prediction(node)
            out[r] = 2 * own - value if self.first else own - value
            stats[node] = _sums(own[drawn.take(r)])
        return out, stats


def _sums(g: np.ndarray) -> np.ndarray:
    return np.array([len(g), g.sum(), g @ g])


@dataclass
class Counted:
    """Histograms (2, nodes, bins) of the counted nodes: rows and sums; the stats of all leaves; those of the finished tree's; where tasks wrote their new targets."""

    hist: np.ndarray
    stats: np.ndarray
    finished: np.ndarray | None
    targets: dict[int, str]

    def __add__(self, other: Counted) -> Counted:
        finished = None if self.finished is None else self.finished + other.finished
        return Counted(self.hist + other.hist, self.stats + other.stats, finished, self.targets | other.targets)


def _count(layout: Layout, tree: Tree, nodes: dict[int, int], draw: Draw, step: Step | None, folder: str, part: int, blocks: list[Block]) -> Counted:
    """A task's counts of ``nodes`` (leaves of ``tree`` so far; node -> place) in its blocks; with ``step`` their targets are moved on and written first."""
    if not gc.get_freeze_count():
        gc.freeze()  # a worker collects garbage after every task and needn't go through all that is imported
    k, size = len(nodes), 1 << layout.width
    joint = np.zeros((layout.n_cols, 2, k * size))
    stats, finished, targets = np.zeros((len(tree.left), 3)), None, {}
    with contextlib.ExitStack() as stack:
        if step:
            finished, targets = np.zeros((len(step.tree.left), 3)), {part: f"{folder}/targets-{draw.tree}-{part}-{uuid.uuid4().hex}"}
            out = stack.enter_context(open(targets[part], "wb"))
        for block in blocks:
            codes, g = block.codes(layout.n_cols), block.target()
            if step:
                g, last = step.moved(layout, block, codes, g)
                finished += last
                out.write(g)
            parts, base = [], []
            for node, r in tree.rows_by_leaf(layout, codes, draw.rows(block)):
                own = g.take(r)
                stats[node] += _sums(own)
                if node in nodes and len(r):
                    parts.append((r, own))
                    base.append(np.full(len(r), nodes[node] * size))
            if not parts:
                continue
            r, own, base = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]), np.concatenate(base)
            code, at = np.empty(len(r), np.uint16), np.empty(len(r), np.int64)
            for c in range(layout.n_cols):
                np.take(codes[c], r, out=code, mode="clip")
                np.add(code, base, out=at)
                joint[c, 0] += np.bincount(at, minlength=k * size)
                joint[c, 1] += np.bincount(at, own, minlength=k * size)
    hist = layout.unpacked(joint.reshape(layout.n_cols, 2, k, size)) if k and layout.n_cols else np.zeros((2, k, 0))
    return Counted(hist, stats, finished, targets)


def _best(layout: Layout, hist: np.ndarray, allowed: np.ndarray, least: int, floor: float) -> tuple[float, int, int, float, float] | None:
    """The split of largest gain of a node with histogram (2, n_bins): gain, feature, bin, rows and sum on the left; of equal ones the first feature's."""
    best, at = None, 0
    for b, feats in layout.classes:
        h = hist[:, at:at + (len(feats) << b)].reshape(2, len(feats), 1 << b)
        at += len(feats) << b
        ok = allowed[feats]
        if not ok.any():
            continue
        feats, below = feats[ok], np.cumsum(h[:, ok], axis=2)
        n, s = below[0, 0, -1], below[1, :, -1:]
        nl, sl = below[0, :, :-1], below[1, :, :-1]
        nr, sr = n - nl, s - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (sl * sl / nl + sr * sr / nr - s * s / n) / n
        gain = np.where((nl >= max(least, 1)) & (nr >= max(least, 1)), gain, -np.inf)
        i, j = divmod(int(gain.argmax()), gain.shape[1])
        found = (float(gain[i, j]), int(feats[i]), j, float(nl[i, j]), float(sl[i, j]))
        if best is None or (found[0], -found[1]) > (best[0], -best[1]):
            best = found
    return best if best and best[0] > 0 and best[0] >= floor else None


def _parts(share: str, d: int) -> int:
    """How many of ``d`` features a node looks at, as ``pyspark.ml`` reads ``featureSubsetStrategy``."""
    named = {"auto": d, "all": d, "sqrt": np.ceil(np.sqrt(d)), "log2": max(1, np.ceil(np.log2(d))), "onethird": np.ceil(d / 3)}
    if share in named:
        return int(named[share])
    return min(int(share), d) if share.isdigit() and int(share) > 1 or share == "1" else int(np.ceil(float(share) * d))


class TableGBT(GBTRegressor):
    """``GBTRegressor`` whose fit reads packed blocks; what it doesn't know (weights, validation rows, another loss, nominal features) goes to ``pyspark.ml``."""

    def _own(self, dataset: DataFrame) -> bool:
        meta = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        unset = [self.weightCol, self.validationIndicatorCol]
        return (not any(self.isDefined(p) for p in unset) and self.getLossType() == "squared" and self.getMinWeightFractionPerNode() == 0
                and self.getMaxBins() <= 1 << 15 and self.getMaxDepth() > 0 and _mounted(shared_dir(dataset.sparkSession, "gbt")) is not None and not {"nominal", "binary"} & set(meta))

    def _fit(self, dataset: DataFrame):
        if not self._own(dataset):
            return super()._fit(dataset)
        rows = dataset.select(F.unwrap_udt(self.getFeaturesCol()).alias("u"), F.col(self.getLabelCol()).cast("double").alias("y"))
        n, d, wrong = rows.agg(F.count(F.lit(1)), F.max(F.coalesce("u.size", F.size("u.values"))), F.count_if(F.col("u").isNull() | F.col("y").isNull() | F.isnan("y"))).first()
        if n < LEAST or wrong or not d:
            return super()._fit(dataset)  # which says what is wrong
        layout = self._layout(rows, n, d)
        folder = _mounted(shared_dir(dataset.sparkSession, "gbt"))
        try:
            trees = self._boost(dataset.sparkSession.sparkContext, self._blocks(rows, layout, n, folder), layout, folder)
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        return self._saved(dataset.sparkSession, trees, layout, d)

    def _layout(self, rows: DataFrame, n: int, d: int) -> Layout:
        """Bins from as many sampled rows as ``pyspark.ml`` takes."""
        bins = min(self.getMaxBins(), n)
        share = min(1.0, max(bins * bins, 10_000) / n)
        some = (rows if share >= 1 else rows.sample(False, share, self.getSeed())).select("u").toArrow().combine_chunks()
        parts = [_entries(b.column("u")) for b in some.to_batches()]
        cols, values = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in (1, 2))
        order = np.argsort(cols, kind="stable")
        cols, values = cols[order].astype(np.int64), values[order]
        ends = np.searchsorted(cols, np.arange(d + 1))
        return Layout([thresholds(values[a:b], some.num_rows, bins) if b > a else np.empty(0) for a, b in zip(ends, ends[1:])])

    def _blocks(self, rows: DataFrame, layout: Layout, n: int, folder: str) -> list[list[Block]]:
        """The rows written in blocks of up to ``ROWS``, shared out evenly; the targets of the first tree are the labels."""
        tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
        most = max(1, min(ROWS, BYTES // (2 * max(1, layout.n_cols)), max(4096, n // (2 * tasks))))

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, count, number = [], 0, TaskContext.get().partitionId() << 32
            os.makedirs(folder, exist_ok=True)
            name, done = f"{folder}/rows-{uuid.uuid4().hex}", []
            with open(name, "wb") as out:
                def block() -> None:
                    start = out.tell()
                    out.write(np.concatenate([c for c, _ in held], axis=1))
                    out.write(bytes(-out.tell() % 8))
                    at = out.tell()
                    out.write(np.concatenate([y for _, y in held]))
                    done.append((number + len(done), count, name, start, name, at))

                for b in batches:
                    for first in range(0, b.num_rows, most):
                        part = b.slice(first, most)
                        if count + part.num_rows > most:
                            block()
                            held, count = [], 0
                        held.append((layout.pack(part.num_rows, *_entries(part.column("u"))), part.column("y").to_numpy()))
                        count += part.num_rows
                if held:
                    block()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["number", "n", "file", "start", "targets", "at"])

        written = rows.mapInArrow(write, "number long, n long, file string, start long, targets string, at long").collect()
        blocks = sorted((Block(*r) for r in written), key=lambda b: (-b.n, b.number))
        parts: list[list[Block]] = [[] for _ in range(min(tasks, len(blocks)))]
        heap = [(0, i) for i in range(len(parts))]
        for b in blocks:
            size, i = heapq.heappop(heap)
            parts[i].append(b)
            heapq.heappush(heap, (size + b.n, i))
        return parts

    def _boost(self, sc: SparkContext, parts: list[list[Block]], layout: Layout, folder: str) -> list[Tree]:
        """The trees, one after the other; a level of a tree is a pass."""
        trees, step = [], None
        rng = np.random.default_rng(self.getSeed() & ((1 << 63) - 1))

        def count(tree: Tree, nodes: dict[int, int], draw: Draw, step: Step | None) -> Counted:
            run = sc.parallelize(list(enumerate(parts)), len(parts)).map(lambda x: _count(layout, tree, nodes, draw, step, folder, *x))
            got = run.treeReduce(operator.add) if len(parts) > TASKS else run.reduce(operator.add)
            if step:
                self._finish(step.tree, got.finished)
                for i, name in got.targets.items():
                    old, at = parts[i][0].targets, 0
                    for b in parts[i]:
                        b.targets, b.at = name, at
                        at += 8 * b.n
                    if os.path.basename(old).startswith("targets-"):
                        os.remove(old)
            return got

        for number in range(self.getMaxIter()):
            draw = Draw(self.getSeed(), number, self.getSubsamplingRate())
            tree = self._grow(count, layout, draw, step, rng)
            trees.append(tree)
            step = Step(tree, draw, 1.0 if number == 0 else self.getStepSize(), number == 0)
        count(Tree(), {}, Draw(0, self.getMaxIter(), 1.0), step)
        return trees

    @staticmethod
    def _finish(tree: Tree, stats: np.ndarray) -> None:
        for i, left in enumerate(tree.left):
            if left < 0:
                tree.stats[i] = stats[i]

    def _grow(self, count: Callable[..., Counted], layout: Layout, draw: Draw, step: Step | None, rng: np.random.Generator) -> Tree:
        tree, d = Tree(), len(layout.splits)
        look, least = _parts(self.getFeatureSubsetStrategy(), d), self.getMinInstancesPerNode()
        at_once = max(1, (self.getMaxMemoryInMB() << 20) // max(1, (16 * layout.n_cols) << layout.width))
        above: dict[int, np.ndarray] = {}
        level = [(0, None)]  # (node, parent); siblings stand side by side, the left one first
        for depth in range(self.getMaxDepth()):
            siblings = [level[i:i + 2] for i in range(0, len(level), 2)]
            smaller = [min(s, key=lambda x: tree.stats[x[0]][0])[0] for s in siblings]
            hists: dict[int, np.ndarray] = {}
            for at in range(0, len(smaller), at_once):
                nodes = {node: i for i, node in enumerate(smaller[at:at + at_once])}
                got = count(tree, nodes, draw, step if depth == 0 else None)
                hists |= {node: got.hist[:, i] for node, i in nodes.items()}
            for node, _ in level:
                tree.stats[node] = got.stats[node]
            for s in siblings:
                for (node, parent), (other, _) in zip(s, s[::-1]):
                    if node not in hists:
                        hists[node] = above[parent] - hists[other]
            nodes, level = [node for node, _ in level], []
            for node in nodes:
                n, total, _ = tree.stats[node]
                allowed = np.zeros(d, bool)
                allowed[rng.permutation(d)[:look] if look < d else slice(None)] = True
                impurity = tree.impurity(node)
                found = None if impurity < EPSILON or n < 2 * least else _best(layout, hists[node], allowed, least, max(self.getMinInfoGain(), 1e-13 * impurity))
                if found:
                    gain, f, b, nl, sl = found
                    tree.split(node, f, b, gain, np.array([nl, sl, 0.0]), np.array([n - nl, total - sl, 0.0]))
                    level += [(tree.left[node], node), (tree.left[node] + 1, node)]
            above = hists
            if not level:
                break
        return tree

    def _saved(self, spark: SparkSession, trees: list[Tree], layout: Layout, d: int) -> GBTRegressionModel:
        """The trees as a model of ``pyspark.ml``: written in its stored form and read."""
        path, now, version = shared_dir(spark, "trees"), int(time.time() * 1000), spark.version
        known = lambda m: {p.name: v for p, v in m.items() if p.name not in ("weightCol", "validationIndicatorCol", "thresholds")}
        params, defaults = known(self._paramMap), known(self._defaultParamMap)
        package = "org.apache.spark.ml.regression"
        about = {"class": f"{package}.GBTRegressionModel", "timestamp": now, "sparkVersion": version, "uid": self.uid, "paramMap": params, "defaultParamMap": defaults,
                 "numFeatures": d, "numTrees": len(trees)}
        part = lambda m: {k: v for k, v in m.items() if k not in ("featureSubsetStrategy", "maxIter", "stepSize", "subsamplingRate", "lossType", "validationTol")}
        of_tree = {"class": f"{package}.DecisionTreeRegressionModel", "timestamp": now, "sparkVersion": version, "paramMap": part(params), "defaultParamMap": part(defaults)}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        meta = [(i, json.dumps({**of_tree, "uid": f"{self.uid}_{i}"}), 1.0 if i == 0 else float(self.getStepSize())) for i in range(len(trees))]
        spark.createDataFrame(meta, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        rows = [(i, node) for i, t in enumerate(trees) for node in _nodes(t, layout)]
        spark.createDataFrame(rows, "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,"
                              "rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>").coalesce(1).write.parquet(f"{path}/data")
        return self._copyValues(GBTRegressionModel.load(path))


def _nodes(tree: Tree, layout: Layout) -> list[tuple]:
    """A tree's nodes as they are stored: numbered from the root down, left before right."""
    order, todo = [], [0]
    while todo:
        i = todo.pop()
        order.append(i)
        if tree.left[i] >= 0:
            todo += [tree.left[i] + 1, tree.left[i]]
    at, out = {node: k for k, node in enumerate(order)}, []
    for i in order:
        inner, stats = tree.left[i] >= 0, [float(x) for x in tree.stats[i]]
        split = (tree.feature[i], [float(layout.splits[tree.feature[i]][tree.bin[i]])], -1) if inner else (-1, [], -1)
        children = (at[tree.left[i]], at[tree.left[i] + 1]) if inner else (-1, -1)
        out.append((at[i], tree.prediction(i), tree.impurity(i), stats, int(stats[0]), float(tree.gain[i]), *children, split))
    return out


def _mounted(path: str) -> str | None:
    """The folder of a path on a file system that all machines have mounted, else none."""
    url = urllib.parse.urlparse(path)
    return urllib.parse.unquote(url.path) if url.scheme in ("", "file") else None


def _entries(vectors: pa.StructArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the entries of vectors, sparse or dense, in their stored form."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    kind, index, value = (vectors.field(i) for i in (0, 2, 3))
    size = np.diff(value.offsets.to_numpy())
    rows = np.repeat(np.arange(len(vectors)), size)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    sparse = np.repeat(kind.to_numpy() == 0, size)
    cols = np.where(sparse, 0, place)
    cols[sparse] = index.flatten().to_numpy()
    return rows, cols, value.flatten().to_numpy()
