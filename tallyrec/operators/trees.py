"""Regression trees for boosting, grown level by level from sums over tasks.

Values are put once into at most ``BINS`` bins, a byte each, so that a row of 83 features takes 83 bytes in the rounds and not 664.
The bins' edges are quantiles over all rows.  A tree of depth 6 takes six passes over the rows: each sums pull, weight and number
of rows by node, feature and bin, of the smaller child of each split node only, as the other is what is left of the parent.
A split's gain is the second-order one, and a leaf's value ``rate * sum(pull) / (sum(weight) + shrink)``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, quantiles of it that are kept on the way to them, and rows that a task works on at once.
BINS, POINTS, CHUNK = 64, 512, 65_536
#: Tasks whose sums are added by the driver; more are added by tasks first.
DIRECT = 16


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pieces(batches: Iterator[pa.RecordBatch], key: str | None = None) -> Iterator[pa.Table]:
    """Tables of about ``CHUNK`` rows; rows in a row with one ``key`` stay in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(len(b) for b in held) >= CHUNK:
            table = pa.Table.from_batches(held)
            cut = CHUNK
            if key is not None:
                keys = table[key].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if not cut:  # one key so far
                    break
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if sum(len(b) for b in held):
        yield pa.Table.from_batches(held)


def _fewer(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``POINTS`` quantiles of each column of weighted ``values``, ends included."""
    if len(values) <= POINTS:
        return values, weights
    order = np.argsort(values, axis=0, kind="stable")
    upto = np.cumsum(weights[order], axis=0)
    asked = np.linspace(0, 1, POINTS)
    at = np.stack([np.minimum(np.searchsorted(upto[:, j], asked * upto[-1, j]), len(values) - 1) for j in range(values.shape[1])], axis=1)
    at[-1] = len(values) - 1
    return np.take_along_axis(np.take_along_axis(values, order, 0), at, 0), np.full(POINTS, weights.sum() / POINTS)


def _point_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for table in pieces(batches):
        x = matrix(table["x"])
        found = _fewer(x, np.ones(len(x)))
        held = found if held is None else _fewer(*(np.concatenate(p) for p in zip(held, found, strict=True)))
    if held is not None:
        yield pa.RecordBatch.from_pydict({"points": pa.array([pickle.dumps(held)], pa.binary())})


def edges_of(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Each feature's ascending edges, from all of ``rows (x)``: a value is in the first bin whose edge isn't below it."""
    points = rows.select("x").mapInArrow(_point_tasks, "points binary").rdd.map(lambda r: pickle.loads(r[0]))
    both = lambda a, b: _fewer(*(np.concatenate(p) for p in zip(a, b, strict=True)))
    found = points.mapPartitionsWithIndex(lambda i, xs: ((i % 16, x) for x in xs)).reduceByKey(both, 16).values().collect()
    if not found:
        return [np.zeros(0)] * width
    values = found[0][0] if len(found) == 1 else _fewer(*(np.concatenate(p) for p in zip(*found, strict=True)))[0]
    out = []
    for column in values.T:
        own = np.unique(column[~np.isnan(column)])
        out.append(own[:-1] if len(own) <= BINS else own[np.linspace(0, len(own) - 2, BINS - 1).round().astype(int)])
    return out


def in_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Features by rows."""
    return np.stack([np.searchsorted(e, x[:, j]).astype(np.uint8) for j, e in enumerate(edges)])


def binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``rows`` with ``bins``, a byte a feature, in place of ``x``."""
    kept = [c for c in rows.columns if c != "x"]

    def run(batches):
        for batch in batches:
            data = np.ascontiguousarray(in_bins(matrix(batch["x"]), edges).T)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * data.shape[1]
            bins = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), bins], [*kept, "bins"])

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", bins binary")


def chunks(rows: DataFrame, build: Callable[[pa.Table], dict], key: str | None = None) -> RDD:
    """``build`` of pieces of ``rows``, with ``at`` as (task, number); what ``build`` returns has arrays by row."""

    def run(batches):
        from pyspark import TaskContext

        for number, table in enumerate(pieces(batches, key)):
            own = build(table) | {"at": (TaskContext.get().partitionId(), number)}
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([pickle.dumps(own, protocol=5)], pa.binary())})

    return rows.mapInArrow(run, "chunk binary").rdd.map(lambda r: pickle.loads(r[0]))


def bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    """A column of ``bins`` as features by rows."""
    column = column.combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.ascontiguousarray(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1).T)


class Tree:
    """One regression tree as arrays: an inner node's feature, bin, threshold and children, a node's value."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.feature, self.bin, self.left, self.right = (np.zeros(0, np.int64) for _ in range(4))
        self.threshold, self.value, self.gain = (np.zeros(0) for _ in range(3))

    def add(self, value: float) -> int:
        for name, x in (("feature", -1), ("bin", -1), ("left", -1), ("right", -1), ("threshold", 0.0), ("value", value), ("gain", 0.0)):
            setattr(self, name, np.append(getattr(self, name), x))
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int, gain: float, left: int, right: int) -> None:
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, left, right
        self.threshold[node], self.gain[node] = self.edges[feature][at], gain

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row (features by rows) has come to."""
        rows, flat = np.arange(bins.shape[1]), bins.ravel()
        node = np.zeros(bins.shape[1], np.int64)
        while (inner := self.left[node] >= 0).any():
            goes_left = flat[np.maximum(self.feature[node], 0) * len(rows) + rows] <= self.bin[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.left[node] >= 0).any():
            goes_left = x[np.arange(len(x)), np.maximum(self.feature[node], 0)] <= self.threshold[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
        return self.value[node]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"edges": None}  # tasks go by bins


def node_sums(bins: np.ndarray, pull: np.ndarray, weight: np.ndarray | None, tree: Tree, slot: np.ndarray, n: int) -> np.ndarray:
    """``n`` nodes by features, bins and (pull, weight, rows); ``slot`` has a node's place, -1 for those that aren't asked."""
    out = np.zeros((n, len(bins), BINS, 3))
    place = slot[tree.leaf_of(bins)]
    some = np.flatnonzero(place >= 0)
    if not len(some):
        return out
    base, pull = place[some] * BINS, pull[some]
    weight = None if weight is None else weight[some]
    whole = len(some) == bins.shape[1]
    at = np.empty(len(some), np.int64)
    for j in range(len(bins)):
        np.add(base, bins[j] if whole else bins[j][some], out=at)
        rows = np.bincount(at, minlength=n * BINS).reshape(n, BINS)
        out[:, j, :, 0] = np.bincount(at, weights=pull, minlength=n * BINS).reshape(n, BINS)
        out[:, j, :, 1] = rows if weight is None else np.bincount(at, weights=weight, minlength=n * BINS).reshape(n, BINS)
        out[:, j, :, 2] = rows
    return out


def added(parts: RDD) -> np.ndarray | None:
    """The sum of arrays, first within their tasks; None if there is none."""

    def one(arrays):
        total = None
        for x in arrays:
            total = x if total is None else total + x
        return [] if total is None else [total]

    summed = parts.mapPartitions(one)
    if summed.getNumPartitions() > DIRECT:
        summed = _gathered(summed)
    found = summed.collect()
    return sum(found[1:], found[0]) if found else None


def _gathered(parts: RDD) -> RDD:
    """At most ``DIRECT`` sums of arrays."""
    return parts.mapPartitionsWithIndex(lambda i, xs: ((i % DIRECT, x) for x in xs)).reduceByKey(np.add, DIRECT).values()


def _best(sums: np.ndarray, allowed: np.ndarray, least_rows: int) -> tuple[float, int, int, np.ndarray] | None:
    """Gain, feature, bin and the left side's sums of a node's best split."""
    total = sums[0].sum(0)
    left = sums.cumsum(1)[:, :-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - total[0] ** 2 / total[1]
    fine = allowed[:, None] & (np.minimum(left[..., 2], right[..., 2]) >= max(1, least_rows)) & (np.minimum(left[..., 1], right[..., 1]) > 0)
    gain = np.where(fine, gain, -np.inf)
    feature, at = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[feature, at] > 1e-12 * max(1.0, abs(total[0])):
        return None
    return float(gain[feature, at]), int(feature), int(at), left[feature, at]


def grow(ask: Callable[[Tree, np.ndarray, int], np.ndarray], edges: list[np.ndarray], *, depth: int, least_rows: int, features_share: float, rate: float, shrink: float, seed: int) -> Tree | None:
    """A tree, or None where there is no row; ``ask(tree, slot, n)`` gives :func:`node_sums` over all rows."""
    tree, rng = Tree(edges), np.random.default_rng(seed)
    width = len(edges)
    value = lambda s: rate * s[0] / (s[1] + shrink) if s[1] + shrink > 0 else 0.0
    tree.add(0.0)
    sums = ask(tree, np.zeros(1, np.int64), 1)
    if sums is None or not (total := sums[0, 0].sum(0))[2]:
        return None
    first = sums[0]
    tree.value[0] = value(total)
    open_ = {0: first}
    for level in range(depth):
        asked: list[tuple[int, int, np.ndarray]] = []
        for node, sums in open_.items():
            allowed = np.zeros(width, bool)
            allowed[rng.permutation(width)[: max(1, int(np.ceil(features_share * width)))]] = True
            found = _best(sums, allowed, least_rows)
            if found is None:
                continue
            gain, feature, at, left = found
            right = sums[0].sum(0) - left
            a, b = tree.add(value(left)), tree.add(value(right))
            tree.split(node, feature, at, gain, a, b)
            if max(left[2], right[2]) >= 2 * max(1, least_rows):
                asked.append((a, b, sums) if left[2] <= right[2] else (b, a, sums))
        if level == depth - 1 or not asked:
            break
        slot = np.full(len(tree.feature), -1, np.int64)
        slot[[small for small, _, _ in asked]] = np.arange(len(asked))
        new = ask(tree, slot, len(asked))
        open_ = {}
        for i, (small, large, sums) in enumerate(asked):
            open_[small], open_[large] = new[i], sums - new[i]
    return tree


class Boosted:
    """Trees that are added up; ``history`` holds the stop part's measure after each round."""

    def __init__(self, trees: list[Tree], columns: tuple[str, ...], history: list[float] | None = None):
        self.trees, self.columns, self.history = trees, tuple(columns), history or []

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prediction``."""
        trees = self.trees

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            v = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            return pd.Series(sum((t.predict(v) for t in trees), np.zeros(len(v))))

        return rows.withColumn("prediction", predict(F.array(*[F.col(c).cast("double") for c in self.columns])))

    def importances(self, spark) -> DataFrame:
        """Each feature's share of the trees' gain."""
        gain = np.zeros(len(self.columns))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(gain, t.feature[inner], t.gain[inner])
        total = gain.sum() or 1.0
        return spark.createDataFrame([(c, float(g), float(g / total)) for c, g in zip(self.columns, gain, strict=True)], "feature string, importance double, share double")
