"""Random forests of many rows from the sums of their cells.

Spark's trees know a row by its bins, at most ``maxBins`` per feature, so rows
of equal bins (a cell) lie in the same node of every tree.  Above ``DIRECT``
rows a forest is fitted in these steps:

* The cut points of each feature come from all rows: every value of a feature
  with few values, else quantiles.
* The bootstrap draws a Poisson(1) weight for every row and tree.
* Rows of a cell are added up: per tree their weight and their weighted mean
  label.  The labels' variance inside a cell is part of a node and of its
  children alike, so a split's gain depends on these sums only.  For classes
  a cell is split by label, and n equal rows draw one Poisson(n).
* Each tree is Spark's, grown on the weighted cells; some grow at a time.

The draws take one pass over the rows; what the trees read is the cells.  They
are at most as many as the rows, and the bins to the power of the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.session import ship_package

#: Up to so many rows a forest is fitted on the rows themselves.
DIRECT = 5_000_000
BINS, AT_ONCE, CELLS_PER_TASK = 32, 4, 250_000


@dataclass
class CellForest:
    """``trees``: forests of one tree on bin numbers; ``edges``: the upper
    ends of each feature's bins but the last."""

    trees: list
    edges: list[np.ndarray]

    @property
    def featureImportances(self):  # noqa: N802 - as Spark's models have it
        """The mean of the trees' importances, with sum 1, as Spark's forests."""
        from pyspark.ml.linalg import Vectors
        total = sum(t.featureImportances.toArray() for t in self.trees)
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)


def cut_points(rows: DataFrame, d: int, bins: int = BINS) -> list[np.ndarray]:
    """Per item of the array ``x`` the bins' upper ends, from all rows."""
    x = [F.col("x")[i] for i in range(d)]
    probs = [k / bins for k in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(c, probs, 2000).alias(f"q{i}") for i, c in enumerate(x)],
                   *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(x)]).first()
    few = [i for i in range(d) if got[f"n{i}"] <= 1.25 * bins]
    values = rows.agg(*[F.collect_set(x[i]).alias(f"v{i}") for i in few]).first() if few else {}
    out = []
    for i in range(d):
        own = np.unique(values[f"v{i}"]) if i in few else ()
        if i in few and len(own) <= bins:
            out.append(own[:-1].astype(float))
        else:
            out.append(np.unique(np.array(got[f"q{i}"], float)))
    return out


def _binned(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(edges)), len(cell), [None, pa.py_buffer(cell.tobytes())])
            yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), batch.column(1)], names=["cell", "y"])
    return run


def _drawn(trees: int, seed: int, classify: bool):
    """Rows (cell, y, n) in the order of their cells → cells with per tree the
    weight and the mean label; a cell cut by a batch stays two rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            if classify:
                w = rng.poisson(batch.column(2).to_numpy(zero_copy_only=False)[:, None], (len(y), trees)).astype(float)
                mean = np.repeat(y[:, None], trees, axis=1)
            else:
                w = rng.poisson(1.0, (len(y), trees)).astype(float)
                first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]).any(axis=1)))
                total = np.add.reduceat(w * y[:, None], first, axis=0)
                w, cell = np.add.reduceat(w, first, axis=0), cell[first]
                mean = total / np.maximum(w, 1.0)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                     for v in (cell.astype(float), w.astype(np.float32), mean)]
            yield pa.RecordBatch.from_arrays(lists, names=["x", "w", "m"])
    return run


def bootstrapped_cells(rows: DataFrame, edges: list[np.ndarray], trees: int, seed: int, classify: bool) -> DataFrame:
    """(x array of bins, w array of weights, m array of labels) of the cells
    of ``rows`` (x array, y)."""
    ship_package(rows.sparkSession)
    binned = rows.mapInArrow(_binned(edges), "cell binary, y double")
    if classify:  # the count of equal rows is all that the draws need
        cells = binned.groupBy("cell", "y").agg(F.count(F.lit(1)).alias("n"))
    else:  # together by cell; a partition that grows too large is split, which cuts a cell in two rows at worst
        cells = binned.withColumn("n", F.lit(1)).hint("rebalance", "cell").sortWithinPartitions("cell", "y")
    return cells.mapInArrow(_drawn(trees, seed, classify), "x array<double>, w array<float>, m array<double>")


def cell_forest(df: DataFrame, kind: str, trees: int, depth: int, features: str = "features", label: str = "label",
                seed: int = 42, **options) -> CellForest:
    """A forest of ``trees`` trees fitted on the bootstrapped cells of ``df``."""
    from pyspark import inheritable_thread_target
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import RandomForestRegressor
    classify = kind == "classification"
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    if not rows.where("y IS NULL OR isnan(y)").isEmpty():
        raise ValueError("labels must not be NULL or NaN")
    edges = cut_points(rows, len(rows.first()["x"]))
    cells = bootstrapped_cells(rows, edges, trees, seed, classify).persist()
    try:
        tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // CELLS_PER_TASK))
        few = cells.select(array_to_vector("x").alias("features"), "w", "m").coalesce(tasks)
        est = (RandomForestClassifier if classify else RandomForestRegressor)(
            numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt" if classify else "onethird", maxBins=BINS,
            maxDepth=depth, weightCol="weight", **(options | {"cacheNodeIds": False}))

        def grown(t: int):
            own = few.select("features", F.col("w")[t].cast("double").alias("weight"), F.col("m")[t].alias("label")).where("weight > 0")
            return est.copy({est.seed: seed + t}).fit(own)
        with ThreadPool(AT_ONCE) as pool:
            return CellForest(pool.map(inheritable_thread_target(df.sparkSession)(grown), range(trees), chunksize=1), edges)
    finally:
        cells.unpersist()


def fit_forest(df: DataFrame, kind: str, trees: int, depth: int, features: str = "features", label: str = "label",
               seed: int = 42, deal=lambda d: d, **options):
    """A random forest with ``featureImportances``: Spark's on the rows (given
    to ``deal`` first) up to ``DIRECT`` of them, else on their cells."""
    if df.count() > DIRECT:
        return cell_forest(df, kind, trees, depth, features, label, seed, **options)
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    cls = RandomForestClassifier if kind == "classification" else RandomForestRegressor
    return cls(numTrees=trees, maxDepth=depth, seed=seed, labelCol=label, featuresCol=features, **options).fit(deal(df))
