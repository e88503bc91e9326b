"""Random forests of many rows, grown on blocks of bin numbers.

Spark's forest keeps every row with its bins and the draws of all trees, some
300 bytes a row in memory or on disk.  Here a row is one byte a feature and its
label, in compressed blocks that are checkpointed once:

* The cut points of each feature come from all rows: every value of a feature
  with few values, else quantiles of the batches' quantiles.
* The bootstrap's Poisson(1) weights of a block are drawn again in each pass,
  from a generator that the block names.
* A pass adds up, for all open nodes of all trees, the weights and the weighted
  labels per bin of the node's own random features; one pass a level.  A task
  holds one block and sums of the size of the model; the tasks' sums are added
  up before they reach the driver.

Splits have the largest fall of the variance (classes: of Gini's impurity), as
Spark's.  The draws differ from Spark's, as with another seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.boosting import BinTree, binned, tree_sum
from tabsight.session import cut_lineage, ship_package

BINS = 32
BLOCK = "part int, at int, n int, size int, bins binary, label binary"
#: Points that stand for a feature's values in a batch, and in a task.
POINTS, TASK_POINTS = 256, 2048
#: Poisson(1) weight by 16 random bits.
DRAW = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]),
                       (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class BlockForest:
    trees: list[BinTree]
    importances: np.ndarray  # tree x feature
    edges: list[np.ndarray]

    @property
    def featureImportances(self):  # noqa: N802 - as Spark's models have it
        """The mean of the trees' importances, each with sum 1, as Spark's forests."""
        from pyspark.ml.linalg import Vectors
        own = self.importances.sum(axis=1, keepdims=True)
        total = (self.importances / np.where(own > 0, own, 1)).sum(axis=0)
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)


def _tasks(df: DataFrame) -> DataFrame:
    """Few tasks for passes that give one array a task; a task's memory does not grow with its rows."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def _fewer(points: np.ndarray, weight: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``most`` points of equal weight in place of many sorted ones."""
    if len(points) <= most:
        return points, weight
    at = np.cumsum(weight)
    wanted = (np.arange(most) + 0.5) * at[-1] / most
    return points[np.searchsorted(at, wanted).clip(max=len(points) - 1)], np.full(most, at[-1] / most)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    points, weight = (np.concatenate(v) for v in zip(*parts))
    order = np.argsort(points, kind="stable")
    return _fewer(points[order], weight[order], most)


def _summed(d: int, few: int):
    """Of each feature a summary of the task's rows: points and weights, and its
    values if they are at most ``few``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(d)]
        values: list = [np.zeros(0)] * d
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.sort(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d).T, axis=1)
            for i in range(d):
                held[i].append(_fewer(x[i], np.ones(len(x[i])), POINTS))
                if len(held[i]) >= 4 * TASK_POINTS // POINTS:
                    held[i] = [_merged(held[i], TASK_POINTS)]
                if values[i] is not None:
                    own = x[i][np.append(True, x[i][1:] != x[i][:-1])]
                    own = np.union1d(values[i], own) if len(own) <= few else own
                    values[i] = own if len(own) <= few else None
        for i in range(d):
            if held[i]:
                points, weight = _merged(held[i], TASK_POINTS)
                yield pa.RecordBatch.from_pylist([{"i": i, "p": points.tolist(), "w": weight.tolist(),
                                                   "v": None if values[i] is None else values[i].tolist()}],
                                                 schema=pa.schema([("i", pa.int32()), ("p", pa.list_(pa.float64())),
                                                                   ("w", pa.list_(pa.float64())), ("v", pa.list_(pa.float64()))]))
    return run


def cut_points(rows: DataFrame, d: int, bins: int = BINS) -> list[np.ndarray]:
    """Per item of the array ``x`` the bins' upper ends, from all rows in one pass."""
    ship_package(rows.sparkSession)
    found: list[list] = [[] for _ in range(d)]
    for r in _tasks(rows.select("x")).mapInArrow(_summed(d, bins), "i int, p array<double>, w array<double>, v array<double>").collect():
        found[r["i"]].append(r)  # one row per task and feature
    out = []
    for own in found:
        values = np.unique(np.concatenate([r["v"] for r in own])) if all(r["v"] is not None for r in own) else None
        if values is not None and len(values) <= bins:
            out.append(values[:-1])
            continue
        points, weight = _merged([(np.array(r["p"]), np.array(r["w"])) for r in own], 1 << 62)
        at = np.cumsum(weight)
        cuts = np.unique(points[np.searchsorted(at, np.arange(1, bins) * at[-1] / bins).clip(max=len(points) - 1)])
        out.append(cuts[cuts < points[-1]])
    return out


def _drawn(rng: np.random.Generator, d: int, m: int) -> list[int]:
    """``m`` of ``d`` features by reservoir sampling, in its order, as Spark's
    forests have them: of equal splits the first feature's is taken."""
    out = list(range(m))
    for i in range(m, d):
        j = int(rng.integers(0, i + 1))
        if j < m:
            out[j] = i
    return out


def _blocks(edges: list[np.ndarray]):
    """Rows (x, y) → blocks of bins, feature after feature, and labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, zstd = TaskContext.get().partitionId(), pa.Codec("zstd")
        for at, batch in enumerate(batches):
            n = batch.num_rows
            if not n:
                continue
            bins = binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), edges).T.tobytes()
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(float).tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v], pa.int32()) for v in (part, at, n, len(bins))),
                 *(pa.array([zstd.compress(v, asbytes=True)], pa.binary()) for v in (bins, label))],
                names=["part", "at", "n", "size", "bins", "label"])
    return run


def block_sums(bins: np.ndarray, y: np.ndarray, weights: np.ndarray, trees: list[BinTree], wanted: list[dict[int, int]],
               features: list[np.ndarray], classes: int, n_bins: int = BINS) -> list[np.ndarray]:
    """Per tree (slot, place of the node's feature, bin, sums): the weight and
    the weighted label, or the weight of each class.  ``bins``: feature x row;
    ``features[t]``: slot x place."""
    d, n = bins.shape
    flat, out = bins.ravel(), []
    for tree, slots, own, w in zip(trees, wanted, features, weights):
        if not slots:
            out.append(np.zeros((0, 0, n_bins, 2)))
            continue
        rows = np.flatnonzero(w)
        slot = _slots(tree, slots, bins, rows)
        open_ = slot >= 0
        if not open_.all():
            rows, slot = rows[open_], slot[open_]
        m = own.shape[1]
        spot = flat[(own.T * n)[:, slot] + rows] + (slot * (m * n_bins) + np.arange(m)[:, None] * n_bins)
        size, u = len(slots) * m * n_bins, w[rows].astype(float)
        if classes:
            got = np.bincount((spot * classes + y[rows].astype(np.int64)).ravel(), np.tile(u, m), size * classes).reshape(-1, classes)
            got = np.concatenate([got.sum(axis=1, keepdims=True), got], axis=1)
        else:
            spot = spot.ravel()
            got = np.stack([np.bincount(spot, np.tile(v, m), size) for v in (u, u * y[rows])], axis=1)
        out.append(got.reshape(len(slots), m, n_bins, -1))
    return out


def _slots(tree: BinTree, slots: dict[int, int], bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The slot of each row's node, or -1."""
    feature, cut, left = (np.array(v) for v in (tree.feature, tree.cut, tree.left))
    slot_of = np.full(len(feature), -1)
    slot_of[list(slots)] = list(slots.values())
    if len(feature) == 1:
        return np.full(len(rows), slot_of[0])
    n, flat, at = bins.shape[1], bins.ravel(), np.zeros(len(rows), np.int64)
    # a leaf sends its rows to itself
    offset, leaf = np.maximum(feature, 0) * n, feature < 0
    cut, left = np.where(leaf, 255, cut), np.where(leaf, np.arange(len(feature)), left)
    for _ in range(_depth(tree)):
        at = left[at] + (flat[offset[at] + rows] > cut[at])
    return slot_of[at]


def _depth(tree: BinTree) -> int:
    deep = [0] * len(tree.feature)
    for i, f in enumerate(tree.feature):
        if f >= 0:
            deep[tree.left[i]] = deep[tree.left[i] + 1] = deep[i] + 1
    return max(deep)


def _counted(trees, wanted, features, classes: int, mean: float, seed: int):
    """One row per task: the sums of its blocks, tree after tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, zstd = None, pa.Codec("zstd")
        for batch in batches:
            for r in batch.to_pylist():
                raw = zstd.decompress(r["bins"], r["size"], asbytes=True)
                bins = np.frombuffer(raw, np.uint8).reshape(-1, r["n"])
                y = np.frombuffer(zstd.decompress(r["label"], 8 * r["n"], asbytes=True), float) - mean
                rng = np.random.default_rng([seed, r["part"], r["at"]])
                weights = DRAW[rng.integers(0, 1 << 16, (len(trees), r["n"]), np.uint16)]
                own = np.concatenate([s.ravel() for s in block_sums(bins, y, weights, trees, wanted, features, classes)])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])
    return run


def best_split(sums: np.ndarray, n_bins: list[int]):
    """(place, cut, gain) of a node's (place, bin, sums), or None; the gain is
    the fall of the impurity times the node's weight."""
    total = sums[0].sum(axis=0)
    low = np.cumsum(sums, axis=1)
    high = total - low

    def score(s):
        return (s[..., 1:] ** 2).sum(axis=-1) / np.maximum(s[..., 0], 1e-300)
    fine = (low[..., 0] > 0.5) & (high[..., 0] > 0.5) & (np.arange(sums.shape[1])[None, :] < np.array(n_bins)[:, None] - 1)
    gain = np.where(fine, score(low) + score(high) - score(total), -np.inf)
    j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[j, cut] > 1e-12 * max(score(total), 1e-300):
        return None
    return int(j), int(cut), float(gain[j, cut])


def block_forest(df: DataFrame, kind: str, trees: int, depth: int, features: str = "features", label: str = "label",
                 seed: int = 42) -> BlockForest:
    """A forest of ``trees`` trees of at most ``depth`` levels of splits, with
    importances."""
    from pyspark.ml.functions import vector_to_array
    ship_package(df.sparkSession)
    classify = kind == "classification"
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    got = rows.agg(F.avg("y").alias("mean"), F.max("y").alias("top"), F.count_if(F.col("y").isNull() | F.isnan("y")).alias("bad")).first()
    if got["bad"]:
        raise ValueError("labels must not be NULL or NaN")
    classes, mean = (int(got["top"]) + 1, 0.0) if classify else (0, got["mean"])
    d = len(rows.first()["x"])
    edges = cut_points(rows, d)
    blocks = _tasks(cut_lineage(rows.mapInArrow(_blocks(edges), BLOCK)))
    m = min(d, math.ceil(math.sqrt(d) if classify else d / 3))  # as Spark's forests choose
    rng = np.random.default_rng(seed)
    grown, importances = [BinTree() for _ in range(trees)], np.zeros((trees, d))
    level = [[0] for _ in range(trees)]
    for _ in range(depth):
        wanted = [{node: s for s, node in enumerate(nodes)} for nodes in level]
        chosen = [np.array([_drawn(rng, d, m) for _ in nodes], np.int64).reshape(-1, m) for nodes in level]
        if not any(wanted):
            break
        flat = tree_sum(blocks.mapInArrow(_counted(grown, wanted, chosen, classes, mean, seed), "x binary"), 1)
        at, k = 0, 1 + max(classes, 1)
        for t, nodes in enumerate(level):
            size = len(nodes) * m * BINS * k
            sums = flat[at:at + size].reshape(len(nodes), m, BINS, k)
            at += size
            level[t] = []
            for s, node in enumerate(nodes):
                best = best_split(sums[s], [len(edges[f]) + 1 for f in chosen[t][s]])
                if best:
                    j, cut, gain = best
                    f = int(chosen[t][s, j])
                    importances[t, f] += gain
                    level[t] += grown[t].split(node, f, cut)
    return BlockForest(grown, importances, edges)
