"""Truncated singular value decomposition by a randomised range finder (D3).

A pass multiplies every row into a d x l block Q (l a little above the wanted
rank, Gaussian at first) and adds up A'(AQ); the result, made orthogonal, is
the next block.  The passes end when the leading directions stand still.  The
last pass takes AQ itself: each partition reduces its rows to the l x l
triangle of a QR decomposition, triangles are stacked and reduced again, and
the last one's singular values and vectors are those of A within the block.

Rows may be dense or sparse vectors (TF-IDF); a task holds a d x l block and
nothing has d x d numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.boosting import _blob, tree_sum
from tabsight.session import ship_package, spread

ROWS = 4096  # rows multiplied at a time


@dataclass
class Block:
    """Some rows: dense ``x``, or sparse (row starts, indices, values)."""

    x: np.ndarray | None
    start: np.ndarray | None = None
    index: np.ndarray | None = None
    value: np.ndarray | None = None

    def times(self, q: np.ndarray) -> np.ndarray:
        if self.x is not None:
            return self.x @ q
        out = np.zeros((len(self.start) - 1, q.shape[1]))
        full = np.flatnonzero(np.diff(self.start))
        if len(full):
            out[full] = np.add.reduceat(self.value[:, None] * q[self.index], self.start[full], axis=0)
        return out

    def turned_times(self, y: np.ndarray, d: int) -> np.ndarray:
        """(these rows)' y"""
        if self.x is not None:
            return self.x.T @ y
        spread_out = self.value[:, None] * np.repeat(y, np.diff(self.start), axis=0)
        return np.stack([np.bincount(self.index, spread_out[:, j], d) for j in range(y.shape[1])], axis=1)

    def sums(self, d: int) -> np.ndarray:
        """Column sums, and the sum of all squares."""
        if self.x is not None:
            return np.append(self.x.sum(axis=0), (self.x * self.x).sum())
        return np.append(np.bincount(self.index, self.value, d), (self.value ** 2).sum())


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[Block]:
    """Batches of (type, indices, values), as a vector column unwraps."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            dense = part.column(0).to_numpy() == 1
            for mask, kind in ((dense, True), (~dense, False)):
                if not mask.any():
                    continue
                own = part.filter(pa.array(mask)) if not mask.all() else part
                value = own.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
                if kind:
                    yield Block(value.reshape(-1, d))
                else:
                    index = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    sizes = own.column(1).value_lengths().to_numpy()
                    yield Block(None, np.concatenate([[0], np.cumsum(sizes)]), index, value)


def _range_pass(q: np.ndarray, first: bool):
    d = len(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros_like(q), np.zeros(d + 1)
        for b in blocks(batches, d):
            total += b.turned_times(b.times(q), d)
            if first:
                sums += b.sums(d)
        yield _blob(np.concatenate([total.ravel(), sums]))
    return run


def _triangles(q: np.ndarray):
    """Each partition's triangle of AQ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, q.shape[1]))
        for b in blocks(batches, len(q)):
            r = np.linalg.qr(np.vstack([r, b.times(q)]), mode="r")
        if len(r):
            yield _blob(np.vstack([r, np.zeros((q.shape[1] - len(r), q.shape[1]))]))
    return run


def _stacked(l: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, l))
        for batch in batches:
            for blob in batch.column(0):
                r = np.linalg.qr(np.vstack([r, np.frombuffer(blob.as_buffer(), float).reshape(-1, l)]), mode="r")
        if len(r):
            yield _blob(np.vstack([r, np.zeros((l - len(r), l))]))
    return run


def qr_triangle(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """Triangle R with R'R = (AQ)'(AQ), reduced over the partitions."""
    parts, l = rows.mapInArrow(_triangles(q), "x binary"), q.shape[1]
    n = parts.rdd.getNumPartitions()
    if n > 16:
        for groups in (int(np.ceil(np.sqrt(n))), 1):
            parts = parts.repartition(groups).mapInArrow(_stacked(l), "x binary")
    r = np.zeros((0, l))
    for row in parts.collect():  # at most 16 triangles
        r = np.linalg.qr(np.vstack([r, np.frombuffer(row["x"], float).reshape(-1, l)]), mode="r")
    return r


@dataclass
class Factors:
    """Right singular vectors (d x k, the largest entry of each positive),
    singular values, and the total variance of the columns."""

    v: np.ndarray
    s: np.ndarray
    variance: float
    passes: int


def randomized_svd(df: DataFrame, vec: str, k: int, more: int = 24, tol: float = 1e-6, max_passes: int = 60,
                   seed: int = 42) -> Factors:
    """The ``k`` leading right singular vectors and values of the rows of the
    vector column ``vec`` (null vectors are left out).  ``tol``: sine of the
    largest angle between the leading directions of two passes."""
    ship_package(df.sparkSession)
    rows = spread(df.where(F.col(vec).isNotNull()).select(F.unwrap_udt(vec).alias("u"))
                  .select("u.type", "u.indices", "u.values", "u.size")).persist()
    try:
        got = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("size", F.size("values"))).alias("d")).first()
        n, d = got["n"], got["d"]
        if not n or not d:
            raise ValueError("no vectors")
        rows = rows.select("type", "indices", "values")
        k = min(k, d, n)
        l = min(d, n, k + more)
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, l)))[0]
        lead, variance, passes = None, 0.0, 0
        while passes < max_passes:
            total = tree_sum(rows.mapInArrow(_range_pass(q, passes == 0), "x binary"))
            passes += 1
            w = total[:d * l].reshape(d, l)
            if passes == 1:
                sums, squares = total[d * l:-1], total[-1]
                variance = float((squares - (sums @ sums) / n) / max(1, n - 1))
            # w = A'A q: the directions within the block, strongest first
            u, _, _ = np.linalg.svd(w, full_matrices=False)
            q, new = u, u[:, :k]
            still = lead is not None and np.linalg.norm(new - lead @ (lead.T @ new), 2) <= tol
            lead = new
            if still:
                break
        r = qr_triangle(rows, q)
        passes += 1
        _, s, vt = np.linalg.svd(r)
        v = q @ vt.T[:, :k]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
        return Factors(v, s[:k], variance, passes)
    finally:
        rows.unpersist()


def project(df: DataFrame, vec: str, v: np.ndarray, names: list[str]) -> DataFrame:
    """``df`` plus one column for each column of ``v``: the row times it (NULL
    for a null vector)."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(v)

    @F.arrow_udf("array<double>")
    def times(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        q = shared.value
        for kind, index, value in columns:
            out: list = [None] * len(kind)
            types = kind.to_numpy(zero_copy_only=False)
            for want in (0, 1):
                at = np.flatnonzero(types == want)
                if len(at):
                    spots = pa.array(at)
                    part = pa.RecordBatch.from_arrays([kind.take(spots).cast(pa.int8()), index.take(spots), value.take(spots)],
                                                      names=["type", "indices", "values"])
                    done = np.concatenate([b.times(q) for b in blocks(iter([part]), len(q))])
                    for i, row in zip(at.tolist(), done):
                        out[i] = row
            yield pa.array(out, pa.list_(pa.float64()))
    u = F.unwrap_udt(vec)
    made = df.withColumn("__p", times(u["type"], u["indices"], u["values"]))
    return made.select(*df.columns, *[F.get("__p", F.lit(j)).alias(c) for j, c in enumerate(names)])
