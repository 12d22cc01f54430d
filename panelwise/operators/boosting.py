"""Boosted regression trees with Huber loss, patience and a held-out stop.

Each round fits one regression tree to the clipped residuals of a fresh 80 percent of
the training rows. Rows are kept as blocks of some ten thousand: the features as codes
of 16 bits, a hash of the key and what the trees so far leave of the target. Each round
cuts them into at most 32 bins, as MLlib does, from the rows of its bag or a sample of them. A level of a tree is one pass, in
which a task adds up count and gradient by node, feature and bin; of two children only the
smaller one is added up, the other is what is left of the parent. Gradients are whole
multiples of a power of two there, so sums do not depend on any order. One more pass
counts the residuals by leaf and by cells 0.001 wide (growth is capped, so there are at
most some thousand of them, in whatever number of rows). From these counts come the
leaf values (median, plus the mean of the deviations from it clipped at delta), the
next delta (a quantile of the absolute residuals) and the held-out loss. Every `KEEP`
rounds what is left is brought up to date in persisted blocks; every `CUT` rounds they
are written to the shared folder, which bounds the lineage and what a lost executor costs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelwise.sources.store import new_path

CELL = 0.001
QUANTILE = 0.9
KEEP, CUT = 4, 40
BINS, SPLIT_ROWS, MOST_CODES = 32, 60_000, 65_536  # bins of a feature, rows that bounds are taken from, codes of a feature
BLOCK, BLOCKS, LEAST = 1 << 15, 16, 10_000  # rows of a block, blocks of a partition at most, rows of one at least
IN_BAG, OUT_OF_BAG, HELD_OUT = 0, 1, 2


def quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """Smallest value with at least a share q of the counts at or below it."""
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(reached, q * reached[-1])])


def huber(residuals: np.ndarray, delta: float) -> np.ndarray:
    """Loss of each residual: half its square, linear beyond delta."""
    size = np.abs(residuals)
    return np.where(size <= delta, size * size / 2, delta * (size - delta / 2))


def leaf_value(residuals: np.ndarray, counts: np.ndarray, delta: float) -> float:
    """Median, plus the mean deviation from it clipped at delta."""
    middle = quantile(residuals, counts, 0.5)
    off = np.clip(residuals - middle, -delta, delta)
    return middle + float(np.average(off, weights=counts))


def goes_on(losses: list[float], loss: float, patience: int, tolerance: float) -> bool:
    """Whether a loss is better by the tolerance than any of the last `patience` ones."""
    recent = losses[-patience:]
    return len(recent) < patience or any(loss + tolerance < x for x in recent)


_TEST = re.compile(r"^\s*(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")
_LEAF = re.compile(r"^\s*Predict: ")


def tree_sql(description: str, names: list[str], values: list[float]) -> str:
    """A tree as nested CASE over its feature columns. Leaves are numbered from left to right, as MLlib does."""
    lines = [line for line in description.splitlines()[1:] if line.strip()]
    leaf = iter(values)

    def read(at: int) -> tuple[str, int]:
        if _LEAF.match(lines[at]):
            return f"{next(leaf)!r}D", at + 1
        _, feature, _, threshold = _TEST.match(lines[at]).groups()
        low, at = read(at + 1)
        high, at = read(at + 1)
        return f"CASE WHEN `{names[int(feature)]}` <= {float(threshold)!r}D THEN {low} ELSE {high} END", at

    return read(0)[0]


@dataclass
class HuberModel:
    """A start value and trees, each as SQL over the feature columns, with what was seen on the way."""

    names: list[str]
    start: float
    step: float
    trees: list[str] = field(default_factory=list)
    deltas: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    misses: list[float] = field(default_factory=list)
    importance: np.ndarray | None = None

    @property
    def getNumTrees(self) -> int:  # noqa: N802, named as in MLlib
        return len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802, named as in MLlib
        total = self.importance.sum()
        return DenseVector(self.importance / total if total else self.importance)

    def prediction(self) -> Column:
        """Start value and the sum over all trees.

        The trees stand in an array that a higher-order function sums up, which
        keeps them out of generated code: some hundred of them exceed what a
        method may hold.
        """
        trees = F.array(*[F.expr(tree) for tree in self.trees]) if self.trees else F.array(F.lit(0.0))
        return F.lit(self.start) + F.lit(self.step) * F.aggregate(trees, F.lit(0.0), lambda total, value: total + value)


# --- rows as blocks


def split_points(values: np.ndarray) -> np.ndarray:
    """Bounds between the bins of a feature: between all its values if few, else at about equal counts, as MLlib cuts."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) <= BINS:
        return (found[:-1] + found[1:]) / 2
    out, stride, reached = [], len(values) / BINS, counts[0]
    target = stride
    for i in range(1, len(found)):
        before, reached = reached, reached + counts[i]
        if abs(before - target) < abs(reached - target):
            out.append((found[i - 1] + found[i]) / 2)
            target += stride
    return np.array(out)


@dataclass
class Scale:
    """Distinct values of each feature among sampled rows, which codes stand for, and those rows.

    A code is the place of the first value that is not below. Where all rows are
    in the sample, codes stand for the values themselves; where not, for all up
    to half the way to the next value.
    """

    exact: bool
    rows: np.ndarray  # of the sample, those that are not held out
    keys: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, rows: DataFrame, n: int) -> Scale:
        if n > SPLIT_ROWS:
            rows = rows.where(F.pmod(F.xxhash64("_key", F.lit("bounds")), F.lit(1_000_000)) < SPLIT_ROWS * 1_000_000 // n)
        table = rows.select(vector_to_array("features").alias("x"), "_key", "held_out").toArrow().combine_chunks()
        x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(table.num_rows, -1)
        held = table.column("held_out").to_numpy().astype(np.bool_)
        return cls(n <= SPLIT_ROWS, x[~held], table.column("_key").to_numpy()[~held].view(np.uint64), [np.unique(c)[:MOST_CODES] for c in x.T])

    def edges(self) -> list[np.ndarray]:
        """Greatest value of each code but the last."""
        return [v[:-1] if self.exact else (v[:-1] + v[1:]) / 2 for v in self.values]

    def bounds(self, number: int, share: int) -> list[np.ndarray]:
        """Bounds of the bins in a round, from the sampled rows in its bag; a bound lies between two codes."""
        out = [split_points(c) for c in self.rows[draws(self.keys, number) < share].T]
        if not self.exact:
            out = [np.unique(e[np.minimum(np.searchsorted(e, b), len(e) - 1)]) if len(e) else b[:0] for b, e in zip(out, self.edges())]
        return out

    def bins(self, bounds: list[np.ndarray]) -> list[np.ndarray]:
        """The bin of every code."""
        tops = self.values if self.exact else [np.append(e, np.inf) for e in self.edges()]
        return [np.searchsorted(b, top).astype(np.uint8) for b, top in zip(bounds, tops)]


Block = dict[str, np.ndarray]
_STATE = "n int, codes binary, hash binary, held binary, off binary"
_FIELDS = {"codes": np.uint16, "hash": np.uint64, "held": np.bool_, "off": np.float64}


def _blocks(edges: list[np.ndarray]):
    """Rows as blocks. What is left of the target (`off`) is all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                n = part.num_rows
                x = np.asarray(part.column("x").flatten()).reshape(n, -1)
                codes = np.stack([np.searchsorted(edges[i], x[:, i]) for i in range(x.shape[1])]).astype(np.uint16)
                y = part.column("_y").to_numpy(zero_copy_only=False)
                hashed = part.column("_key").to_numpy(zero_copy_only=False).view(np.uint64)
                held = part.column("held_out").to_numpy(zero_copy_only=False).astype(np.bool_)
                fields = (pa.array([a.tobytes()], pa.binary()) for a in (codes, hashed, held, y))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *fields], names=["n", *_FIELDS])

    return run


def _block(row: Row) -> Block:
    block = {name: np.frombuffer(row[name], kind) for name, kind in _FIELDS.items()}
    block["codes"] = block["codes"].reshape(-1, row["n"])
    return block


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _P[1]
    x = (x ^ x >> np.uint64(29)) * _P[2]
    return x ^ x >> np.uint64(32)


def draws(keys: np.ndarray, number: int) -> np.ndarray:
    """xxhash64(key, number), as SQL has it, modulo 1000; for keys as unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = np.uint64(42) + _P[4] + np.uint64(8)
        x = x ^ _rotated(keys * _P[1], 31) * _P[0]
        x = _mixed(_rotated(x, 27) * _P[0] + _P[3])
        x = (x + _P[4] + np.uint64(4)) ^ np.uint64(number) * _P[0]
        x = _mixed(_rotated(x, 23) * _P[1] + _P[2])
    return np.mod(x.view(np.int64), 1000)


# --- trees


@dataclass
class Tree:
    """A full binary tree: node i has children 2i + 1 and 2i + 2; a node without a split sends all to the left."""

    depth: int
    feature: np.ndarray
    bound: np.ndarray  # the last code that goes to the left
    limit: np.ndarray  # the value between that code and the next
    values: np.ndarray | None = None

    @classmethod
    def empty(cls, depth: int) -> Tree:
        return cls(depth, np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, MOST_CODES, np.int64), np.zeros(2**depth - 1))

    def nodes(self, codes: np.ndarray, level: int) -> np.ndarray:
        """The node of each row at a level, from 0 at the left."""
        n, at = codes.shape[1], np.zeros(codes.shape[1], np.int64)
        flat, rows = codes.ravel(), np.arange(n)
        for deep in range(level):
            node = at + (2**deep - 1)
            at = 2 * at + (flat[self.feature[node] * n + rows] > self.bound[node])
        return at

    def leaves(self) -> list[int]:
        """Places at the lowest level that rows can reach, from left to right."""
        reached = [0]
        for level in range(self.depth):
            first = 2**level - 1
            reached = [c for i in reached for c in ((2 * i, 2 * i + 1) if self.bound[first + i] < MOST_CODES else (2 * i,))]
        return reached

    def description(self) -> str:
        """The splits in the notation of MLlib, which `tree_sql` reads."""

        def lines(level: int, i: int) -> list[str]:
            if level == self.depth:
                return ["Predict: 0"]
            node = 2**level - 1 + i
            if self.bound[node] == MOST_CODES:
                return lines(level + 1, 2 * i)
            f, t = int(self.feature[node]), float(self.limit[node])
            return [f"If (feature {f} <= {t!r})", *lines(level + 1, 2 * i), f"Else (feature {f} > {t!r})", *lines(level + 1, 2 * i + 1)]

        return "\n".join(["Tree", *lines(0, 0)])


def _left(block: Block, trees: list[Tree]) -> np.ndarray:
    """What the trees leave of the target."""
    off = block["off"]
    for tree in trees:
        off = off - tree.values[tree.nodes(block["codes"], tree.depth)]
    return off


_COUNT, _MIDDLE = 1 << 35, 1 << 18  # a count and a gradient that is not negative share one number


def _sums(trees: list[Tree], tree: Tree, level: int, slots: np.ndarray, number: int, share: int, delta: float, unit: float, bins: list[np.ndarray]) -> Callable:
    """Count and gradient in units by feature, slot of the node and bin, of the rows in the bag: one array a task."""

    def run(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        total = None
        for block in blocks:
            bag = np.flatnonzero(~block["held"] & (draws(block["hash"], number) < share))
            slot = slots[tree.nodes(block["codes"], level)[bag]]
            bag, slot = bag[slot >= 0], slot[slot >= 0] * BINS
            weight = np.rint(np.clip(_left(block, trees)[bag], -delta, delta) / unit) + (_MIDDLE + _COUNT)
            size = (int(slots.max()) + 1) * BINS
            found = np.stack([np.bincount(slot + of[row[bag]], weight, size) for of, row in zip(bins, block["codes"])]).astype(np.int64)
            parts = np.stack([found // _COUNT, found % _COUNT - found // _COUNT * _MIDDLE])
            total = parts if total is None else total + parts
        if total is not None:
            yield total

    return run


def _moved(trees: list[Tree]) -> Callable:
    return lambda block: {**block, "off": _left(block, trees)}


_UNIT = 2.0**-32


def _summed(keys: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and sums by key, the keys in order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first), np.add.reduceat(total[order], first)


_FAR = 1 << 40  # cells that are farther than this from 0 count as one


def _cells(trees: list[Tree], tree: Tree | None, number: int, share: int) -> Callable:
    """How many residuals a role, leaf and cell has, and their sum in units: three arrays a task."""

    def run(blocks: Iterator[Block]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for block in blocks:
            off = _left(block, trees)
            role = np.where(block["held"], HELD_OUT, np.where(draws(block["hash"], number) < share, IN_BAG, OUT_OF_BAG))
            leaf = tree.nodes(block["codes"], tree.depth) if tree else np.zeros(len(off), np.int64)
            cell = np.clip(np.floor(off / CELL), -_FAR, _FAR - 1).astype(np.int64)
            keys = (role << 16 | leaf) * (2 * _FAR) + cell + _FAR
            out.append(_summed(keys, np.ones(len(off), np.int64), np.rint(off / _UNIT).astype(np.int64)))
        if out:
            yield _summed(*(np.concatenate(x) for x in zip(*out)))

    return run


def counted(state: RDD, trees: list[Tree], tree: Tree | None, number: int, share: int) -> tuple[np.ndarray, ...]:
    """Role, leaf, mean residual and number of rows of every cell, in a fixed order."""
    parts = state.mapPartitions(_cells(trees, tree, number, share)).collect()
    keys, n, total = _summed(*(np.concatenate(x) for x in zip(*parts)))
    group = keys // (2 * _FAR)
    return group >> 16, group & 0xFFFF, total * _UNIT / n, n.astype(float)


def _best(n: np.ndarray, s: np.ndarray, least: int) -> tuple[float, int, int]:
    """Gain, feature and last bin at the left of the best split of a node, from its counts and sums by feature and bin."""
    left_n, left_s = n.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
    all_n, all_s = n.sum(1, keepdims=True), s.sum(1, keepdims=True)
    right_n, right_s = all_n - left_n, all_s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + right_s**2 / right_n - all_s**2 / all_n
    gain = np.where((left_n >= max(least, 1)) & (right_n >= max(least, 1)), gain, -np.inf)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def grow(state: RDD, trees: list[Tree], number: int, share: int, delta: float, settings, scale: Scale) -> tuple[Tree, np.ndarray]:
    """A tree on the clipped residuals of the rows in the bag, and the gain of each feature."""
    width, bounds = len(scale.values), scale.bounds(number, share)
    bins = scale.bins(bounds)
    tree, gains = Tree.empty(settings.depth), np.zeros(width)
    unit = 2.0 ** math.ceil(math.log2(delta)) / _MIDDLE if delta > 0 else 1.0
    wanted, parents = [0], {}
    for level in range(settings.depth):
        slots = np.full(2**level, -1, np.int64)
        slots[wanted] = np.arange(len(wanted))
        parts = state.mapPartitions(_sums(trees, tree, level, slots, number, share, delta, unit, bins)).collect()
        sums = sum(parts).reshape(2, width, len(wanted), BINS)
        known = {node: sums[:, :, i] for i, node in enumerate(wanted)}
        # the other child is what the smaller one leaves of the parent
        known |= {node ^ 1: parents[node // 2] - known[node] for node in wanted if level}
        wanted, parents = [], known
        for node, (n, s) in sorted(known.items()):
            gain, feature, bound = _best(n.astype(float), s * unit, settings.min_leaf)
            if gain <= 1e-12:
                continue
            place = 2**level - 1 + node
            tree.feature[place], tree.limit[place] = feature, bounds[feature][bound]
            tree.bound[place] = np.searchsorted(bins[feature], bound, side="right") - 1
            gains[feature] += gain
            wanted.append(2 * node + int(2 * n[feature, : bound + 1].sum() > n[feature].sum()))
        if not wanted:
            break
    return tree, gains


def _cut(state: DataFrame) -> RDD:
    path = new_path(state.sparkSession, "boosting")
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path).rdd.map(_block)


def _as_rows(state: RDD, spark: SparkSession) -> DataFrame:
    rows = state.map(lambda block: (block["codes"].shape[1], *(bytearray(block[name].tobytes()) for name in _FIELDS)))
    return spark.createDataFrame(rows, _STATE)


def _as_blocks(rows: DataFrame, edges: list[np.ndarray], n: int) -> DataFrame:
    """Rows as blocks, spread over as many partitions as there are tasks at a time: less for few rows, more for very many."""
    parts = max(min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)), -(-n // (BLOCK * BLOCKS)), 1)
    blocks = rows.select(vector_to_array("features").alias("x"), "_y", "held_out", "_key").mapInArrow(_blocks(edges), _STATE)
    return blocks.repartition(parts)


def fit_huber(rows: DataFrame, names: list[str], target: str, settings) -> HuberModel:
    """Boost on rows with `features` (a vector of `names`), the target, `held_out` and `_key`, a hash of the row's key.

    Stops when the held-out loss is not better by `settings.tolerance` than all
    but worse than or equal to the last `settings.patience` ones, as the loss of
    early rounds counts until it is `patience` rounds old.
    """
    base = rows.select("features", F.col(target).cast("double").alias("_y"), "held_out", "_key")
    n_rows = base.count()
    scale = Scale.of(base, n_rows)
    share = round(settings.sample * 1000)
    state = _cut(_as_blocks(base, scale.edges(), n_rows)).persist(StorageLevel.MEMORY_AND_DISK)
    older: RDD | None = None
    role, _, at, n = counted(state, [], None, 0, share)
    model = HuberModel(names, quantile(at[role != HELD_OUT], n[role != HELD_OUT], 0.5), settings.step, importance=np.zeros(len(names)))
    at = at - model.start
    start = Tree.empty(0)
    start.values = np.array([model.start])
    recent = [start]
    for number in range(settings.rounds):
        fitted = role != HELD_OUT
        delta = quantile(np.abs(at[fitted]), n[fitted], QUANTILE)
        tree, gains = grow(state, recent, number, share, delta, settings, scale)
        # a pass has filled the cache of this state, so the one before is done with
        if older is not None:
            older.unpersist()
            older = None
        role, leaf, at, n = counted(state, recent, tree, number, share)
        bag, reached = role == IN_BAG, tree.leaves()
        values = np.zeros(2**settings.depth)
        for i in reached:
            here = bag & (leaf == i)
            values[i] = leaf_value(at[here], n[here], delta) if here.any() else 0.0
        if gains.sum() > 0:
            model.importance += _decrease(np.clip(at, -delta, delta)[bag], leaf[bag], n[bag]) * gains / gains.sum()
        model.trees.append(tree_sql(tree.description(), names, [float(values[i]) for i in reached]))
        at = at - settings.step * values[leaf]
        out = role == HELD_OUT
        loss = float(np.average(huber(at[out], delta), weights=n[out])) if out.any() else 0.0
        model.misses.append(float(np.average(np.abs(at[out]), weights=n[out])) if out.any() else 0.0)
        better = goes_on(model.losses, loss, settings.patience, settings.tolerance)
        model.deltas.append(delta)
        model.losses.append(loss)
        if not better:
            break
        tree.values = settings.step * values
        recent.append(tree)
        if number % KEEP == KEEP - 1:
            moved = state.map(_moved(recent))
            moved = _cut(_as_rows(moved, rows.sparkSession)) if number % CUT == CUT - 1 else moved
            older, state, recent = state, moved.persist(StorageLevel.MEMORY_AND_DISK), []
    if older is not None:
        older.unpersist()
    state.unpersist()
    return model


def _leaves(tree: DecisionTreeRegressionModel) -> int:
    return (tree.numNodes + 1) // 2


def _decrease(gradient: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> float:
    """By how much the leaves lower the sum of squares: the weight of a tree among the importances."""
    sums, sizes = np.bincount(leaf, gradient * n), np.bincount(leaf, n)
    there = sizes > 0
    return float((sums[there] ** 2 / sizes[there]).sum() - sums.sum() ** 2 / sizes.sum())
