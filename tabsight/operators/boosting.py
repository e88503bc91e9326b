"""Gradient boosting of several classes as one model (M2).

Every round grows one tree per class on the gradients and Hessians of the
softmax loss, which all classes share: one pass over the rows serves a level
of all K trees.

* Features are binned once, at quantiles; a row is ``d`` bytes, its label and
  its K margins, kept in blocks of rows.
* A pass adds up, for the nodes it is asked for, gradient, Hessian and row
  count per (class, node, feature, bin).  Partitions are added up in steps
  (groups of about the root of their number first), and only the smaller child of a split is counted: its sibling is the parent minus it.
* The first pass of a round adds the trees of the round before to the
  margins; the blocks are persisted, and checkpointed every
  ``checkpoint_rounds`` rounds, so lost executors cost few rounds.

A leaf's value is step * (K - 1) / K * G / (H + ridge), and a split's gain that
of the second-order loss.  What reaches the driver has the size of the model:
K * nodes * d * bins sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.session import cut_lineage, ship_package, spread

BLOCK = "n int, bins binary, label binary, margin binary"


@dataclass
class BinTree:
    """Nodes in arrays; a row goes left where its bin is at most ``cut``.  A
    leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        """The children's numbers; the right one follows the left one."""
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for column, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, 0.0), (self.rows, 0.0)):
            column += [new, new]
        return at, at + 1

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            go_right = bins[rows, np.maximum(feature[at], 0)] > cut[at]
            at = np.where(inner, left[at] + go_right, at)

    def apply(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(bins)]


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def histograms(bins: np.ndarray, label: np.ndarray, margin: np.ndarray, trees: list[BinTree],
               wanted: list[dict[int, int]], n_slots: int, n_bins: int) -> np.ndarray:
    """(gradient, Hessian, rows) x slot x feature x bin; ``wanted[k]`` maps
    the nodes of class k's tree to slots.  The gradient is that by which the
    margin should rise."""
    n, d = bins.shape
    p = softmax(margin)
    out = np.zeros((3, n_slots * d * n_bins))
    spot = np.arange(d) * n_bins + bins
    for k, (tree, slots) in enumerate(zip(trees, wanted)):
        if not slots:
            continue
        slot_of = np.full(len(tree.feature), -1)
        slot_of[list(slots)] = list(slots.values())
        slot = slot_of[tree.nodes_of(bins)]
        rows = np.flatnonzero(slot >= 0)
        at = (slot[rows, None] * (d * n_bins) + spot[rows]).ravel()
        pk = p[rows, k]
        for c, weight in enumerate(((label[rows] == k) - pk, pk * (1 - pk), np.ones(len(rows)))):
            out[c] += np.bincount(at, np.repeat(weight, d), out.shape[1])
    return out.reshape(3, n_slots, d, n_bins)


def best_splits(hist: np.ndarray, ridge: float, min_rows: int, min_gain: float = 1e-10):
    """For each slot (feature, cut, sums of the left, sums of the right), or
    None where no cut gains; the first feature and cut among equals."""
    total = hist[:, :, 0, :].sum(axis=2)[:, :, None, None]
    low = np.cumsum(hist, axis=3)
    high = total - low

    def score(s):
        return s[0] ** 2 / (s[1] + ridge)
    gain = np.where((low[2] >= min_rows) & (high[2] >= min_rows), score(low) + score(high) - score(total), -np.inf)
    out = []
    for s in range(hist.shape[1]):
        f, cut = np.unravel_index(int(gain[s].argmax()), gain[s].shape)
        out.append((int(f), int(cut), low[:, s, f, cut], high[:, s, f, cut]) if gain[s, f, cut] > min_gain else None)
    return out


class SoftmaxModel:
    """``edges[j]``: bin b of feature j holds x <= edges[j][b]; a missing
    value is in the last bin.  ``rounds[r][k]``: tree of class k."""

    def __init__(self, edges: list[np.ndarray], prior: np.ndarray, rounds: list[list[BinTree]], loss: list[float],
                 features: str):
        self.edges, self.prior, self.rounds, self.loss, self.features = edges, prior, rounds, loss, features
        self.numClasses = len(prior)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.prior, (len(bins), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.apply(bins)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus probability (vector), and prediction (the first class
        of the highest probability)."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("array<double>")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared.value
            for batch in batches:
                p = softmax(model.margins(binned(_matrix(batch, len(model.edges)), model.edges)))
                yield pa.array(list(p), pa.list_(pa.float64()))
        scored = df.withColumn("probability", score(vector_to_array(self.features)))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("probability"))

    def packed(self):
        """The trees for ``tree_explain``: margins without the prior."""
        from tabsight.operators.tree_explain import _pack
        out = []
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                nodes = {}
                for i, f in enumerate(tree.feature):
                    split = {"featureIndex": f, "numCategories": -1,
                             "leftCategoriesOrThreshold": [float(self.edges[f][tree.cut[i]])] if f >= 0 else []}
                    nodes[i] = {"leftChild": tree.left[i] if f >= 0 else -1, "rightChild": tree.left[i] + 1 if f >= 0 else -1,
                                "split": split, "impurityStats": [tree.rows[i]], "prediction": tree.value[i]}
                one = _pack(nodes, None, 1.0)
                one.value = one.value * np.eye(self.numClasses)[k]
                out.append(one)
        return out


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def bin_edges(df: DataFrame, features: str, d: int, n_bins: int, error: float = 0.001) -> list[np.ndarray]:
    """At most n_bins - 1 distinct inner quantiles of every feature, from one
    mergeable sketch per feature; missing values are left out."""
    from pyspark.ml.functions import vector_to_array
    wide = df.select(vector_to_array(features).alias("x")).select(
        *[F.when(~F.isnan(F.get("x", F.lit(j))), F.get("x", F.lit(j))).alias(f"x{j}") for j in range(d)])
    shares = [i / n_bins for i in range(1, n_bins)]
    return [np.unique(np.array(q, float)) for q in wide.approxQuantile(wide.columns, shares, error)]


def _blocks(edges, prior):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = binned(_matrix(batch.column(0), len(edges)), edges)
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            margin = np.tile(prior, (len(bins), 1))
            yield _block(bins, label, margin)
    return run


def _block(bins: np.ndarray, label: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([len(bins)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (bins, label, margin))],
        names=["n", "bins", "label", "margin"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for n, bins, label, margin in zip(*(c.to_pylist() for c in batch.columns)):
            yield (np.frombuffer(bins, np.uint8).reshape(n, -1), np.frombuffer(label, np.int32),
                   np.frombuffer(margin, float).reshape(n, -1))


def _raised(trees: list[BinTree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, label, margin in _opened(batches):
            yield _block(bins, label, margin + np.stack([t.apply(bins) for t in trees], axis=1))
    return run


def _counted(trees, wanted, n_slots, n_bins):
    """One row per partition: the sums of its histograms and, last, the loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for bins, label, margin in _opened(batches):
            own = histograms(bins, label, margin, trees, wanted, n_slots, n_bins).ravel()
            loss = -np.log(np.maximum(softmax(margin)[np.arange(len(label)), label], 1e-300)).sum()
            own = np.append(own, loss)
            total = own if total is None else total + own
        if total is not None:
            yield _blob(total)
    return run


def _blob(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column(0):
            own = np.frombuffer(blob.as_buffer(), float)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield _blob(total)


def tree_sum(parts: DataFrame, most: int = 16) -> np.ndarray:
    """Sum of the arrays in the one binary column: with many partitions in
    groups of about the root of their number, then in one task; the driver
    gets at most ``most`` arrays."""
    n = parts.rdd.getNumPartitions()
    for groups in [int(np.ceil(np.sqrt(n)))] * (n > 16) + [1] * (n > most):
        parts = parts.repartition(groups).mapInArrow(_added, "x binary")
    return sum(np.frombuffer(r["x"], float) for r in parts.collect())


class SoftmaxBoosting:
    """Estimator with ``fit`` and, of the model, ``transform``, as Spark ML has
    them.  Labels are 0.0 … K - 1."""

    def __init__(self, rounds: int = 50, depth: int = 3, step: float = 0.1, bins: int = 32, ridge: float = 1.0,
                 min_rows: int = 1, label: str = "label", features: str = "features", checkpoint_rounds: int = 10,
                 n_classes: int | None = None):
        self.rounds, self.depth, self.step, self.bins, self.ridge, self.min_rows = rounds, depth, step, bins, ridge, min_rows
        self.label, self.features, self.checkpoint_rounds, self.n_classes = label, features, checkpoint_rounds, n_classes
        if not 2 <= bins <= 256:
            raise ValueError("bins: 2 to 256")

    def hasParam(self, name: str) -> bool:  # noqa: N802 - as Spark ML names it
        return False

    def fit(self, df: DataFrame, edges: list[np.ndarray] | None = None) -> SoftmaxModel:
        from pyspark.ml.functions import vector_to_array
        ship_package(df.sparkSession)
        rows = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("int").alias("y")).where("y IS NOT NULL")
        counts = dict(rows.groupBy("y").count().collect())  # one row per class
        if not counts or min(counts) < 0:
            raise ValueError("labels must be 0 … K - 1, and some row must have one")
        classes = self.n_classes or max(counts) + 1
        n = sum(counts.values())
        prior = np.log(np.maximum([counts.get(k, 0) / n for k in range(classes)], 1e-12))
        d = len(rows.first()["x"])
        edges = edges or bin_edges(df, self.features, d, self.bins)
        blocks = spread(rows).mapInArrow(_blocks(edges, prior), BLOCK).persist()
        done, loss, held = [], [], [blocks]
        for r in range(self.rounds):
            trees, first_loss = self._round(blocks, classes, n)
            loss.append(first_loss / n)
            done.append(trees)
            blocks = blocks.mapInArrow(_raised(trees), BLOCK)
            if (r + 1) % self.checkpoint_rounds == 0:
                blocks = cut_lineage(blocks)
            else:
                blocks = blocks.persist()
                held.append(blocks)
            for old in held[:-2]:
                old.unpersist()
            held = held[-2:]
        empty: list[dict[int, int]] = [{} for _ in range(classes)]
        final = tree_sum(blocks.mapInArrow(_counted([BinTree()] * classes, empty, 0, self.bins), "x binary"))
        loss.append(float(final[-1]) / n)
        for old in held:
            old.unpersist()
        return SoftmaxModel(edges, prior, done, loss, self.features)

    def _round(self, blocks: DataFrame, classes: int, n: int) -> tuple[list[BinTree], float]:
        """One tree per class, and the loss before them."""
        trees = [BinTree() for _ in range(classes)]
        scale = self.step * (classes - 1) / classes
        # nodes to split at this level: (class, node) -> histogram of its parent's other child, if counted
        level = [(k, 0, None) for k in range(classes)]
        loss, known = None, {}
        for depth in range(self.depth):
            ask = [(k, node) for k, node, derive in level if derive is None]
            wanted: list[dict[int, int]] = [{} for _ in range(classes)]
            for slot, (k, node) in enumerate(ask):
                wanted[k][node] = slot
            got = tree_sum(blocks.mapInArrow(_counted(trees, wanted, len(ask), self.bins), "x binary"), 1)
            if loss is None:
                loss = float(got[-1])
            hist = got[:-1].reshape(3, len(ask), -1, self.bins)
            here = {key: hist[:, slot] for slot, key in enumerate(ask)}
            for k, node, derive in level:
                if derive is not None:  # parent minus sibling
                    parent, sibling = derive
                    here[k, node] = known[k, parent] - here[k, sibling]
            keys = [(k, node) for k, node, _ in level]
            found = best_splits(np.stack([here[key] for key in keys], axis=1), self.ridge, self.min_rows)
            level = []
            for (k, node), best in zip(keys, found):
                sums = here[k, node][:, 0].sum(axis=1)
                if depth == 0:
                    trees[k].rows[0], trees[k].value[0] = float(sums[2]), scale * float(sums[0] / (sums[1] + self.ridge))
                if best is None:
                    continue
                f, cut, low, high = best
                kids = trees[k].split(node, f, cut)
                for kid, s in zip(kids, (low, high)):
                    trees[k].rows[kid], trees[k].value[kid] = float(s[2]), scale * float(s[0] / (s[1] + self.ridge))
                small, large = kids if low[2] <= high[2] else kids[::-1]
                level += [(k, small, None), (k, large, (node, small))]
            known = here
            if not level:
                break
        return trees, loss
