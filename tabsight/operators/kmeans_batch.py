"""k-means for several k and several starts in shared passes.

All runs (k, start) advance together, one pass over the rows per iteration.
A row keeps, for each run, its cluster and a margin: how much nearer its
centre is than the second nearest could be.  When centres move by at most m,
the margin shrinks by at most 2 m (triangle inequality); while it stays
positive the row cannot change its cluster, and only the other rows are
compared with the centres again.  A block of rows carries the sums of its
clusters, so unchanged rows cost nothing there either, and the inertia follows
from the sums.

Starts come from a sample of ``sample_rows`` rows (in the order of a hash; the
only thing that reaches the driver besides the sums): k-means++ with several
trials per centre, then iterations within the sample.  The sample decides
where a run begins, not what it computes; every pass reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.boosting import _added, _matrix, tree_sum
from tabsight.session import cut_lineage, ship_package, spread

STATE = "n int, x binary, cluster binary, margin binary, sums binary"
MAX_K = 255  # a row keeps its cluster in a byte


@dataclass
class Run:
    k: int
    centres: np.ndarray
    moved: np.ndarray | None = None  # by centre, since the last pass; None: compare all rows
    inertia: float = np.inf
    passes: int = 0


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, distance, distance to the second nearest centre)."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0.0)
    own = d.argmin(axis=1)
    rows = np.arange(len(x))
    best = d[rows, own]
    d[rows, own] = np.inf
    return own, np.sqrt(best), np.sqrt(d.min(axis=1)) if len(centres) > 1 else np.full(len(x), np.inf)


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """k x (count, sums)."""
    out = np.zeros((k, 1 + x.shape[1]))
    out[:, 0] = np.bincount(own, minlength=k)
    np.add.at(out[:, 1:], own, x)
    return out


# ---------------------------------------------------------------------- starts
def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ with 2 + log k trials for each further centre."""
    trials = 2 + int(np.log(max(k, 1)))
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        total = near.sum()
        at = rng.choice(len(x), trials, p=near / total) if total > 0 else rng.integers(len(x), size=trials)
        each = np.minimum(near[None], ((x[None] - x[at][:, None]) ** 2).sum(2)) if len(x) * trials * x.shape[1] <= 1 << 24 else \
            np.stack([np.minimum(near, ((x - x[a]) ** 2).sum(1)) for a in at])
        best = int(each.sum(1).argmin())
        centres.append(x[at[best]])
        near = each[best]
    return np.array(centres)


def sample_start(x: np.ndarray, k: int, seed: int, tries: int = 4) -> np.ndarray:
    """The best of several seeded k-means++ starts after a few iterations on
    the sample, iterated on."""
    found = [_iterated(x, plus_plus(x, k, np.random.default_rng([seed, k, t])), 8) for t in range(tries)]
    return _iterated(x, min(found, key=lambda c: (_nearest(x, c)[1] ** 2).sum()), 50)


def _iterated(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        s = _sums(x, _nearest(x, centres)[0], len(centres))
        new = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), centres)
        if np.abs(new - centres).max() <= 1e-9:
            break
        centres = new
    return centres


# ---------------------------------------------------------------------- passes
def _opening(centre: np.ndarray, runs: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), len(centre)) - centre
                yield _state(x, np.zeros((len(x), runs), np.uint8), np.full((len(x), runs), -1.0, np.float32),
                             np.zeros((cells, 1 + len(centre))), np.zeros(0))
    return run


def _state(x, cluster, margin, sums, changed) -> pa.RecordBatch:
    blobs = (x.tobytes(), cluster.tobytes(), margin.tobytes(), np.append(sums.ravel(), changed).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)],
                                      names=["n", "x", "cluster", "margin", "sums"])


def _advance(runs: list[Run], live: list[int], d: int):
    """One iteration of the live runs: clusters, margins and sums of each
    block, and behind the sums how many rows each run compared."""
    first = np.cumsum([0] + [r.k for r in runs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(blobs[0], float).reshape(n, d)
                cluster = np.frombuffer(blobs[1], np.uint8).reshape(n, len(runs)).copy()
                margin = np.frombuffer(blobs[2], np.float32).reshape(n, len(runs)).copy()
                sums = np.frombuffer(blobs[3], float)[:first[-1] * (1 + d)].reshape(-1, 1 + d).copy()
                compared = np.zeros(len(runs))
                for i in live:
                    r, part = runs[i], sums[first[i]:first[i + 1]]
                    own = cluster[:, i].astype(np.int64)
                    if r.moved is None:
                        todo = np.arange(n)
                    else:
                        margin[:, i] -= (r.moved[own] + r.moved.max()).astype(np.float32)
                        todo = np.flatnonzero(margin[:, i] <= 1e-6 * np.abs(r.centres).max())
                    compared[i] = len(todo)
                    for at in range(0, len(todo), 1 << 15):
                        rows = todo[at:at + (1 << 15)]
                        new, best, second = _nearest(x[rows], r.centres)
                        margin[rows, i] = second - best
                        if r.moved is None:
                            part += _sums(x[rows], new, r.k)
                        else:
                            other = new != own[rows]
                            part += _sums(x[rows[other]], new[other], r.k) - _sums(x[rows[other]], own[rows[other]], r.k)
                        cluster[rows, i] = new
                yield _state(x, cluster, margin, sums, compared)
    return run


def batched_kmeans(df: DataFrame, vec: str, ks: list[int], starts: int = 5, seed: int = 42, max_passes: int = 100,
                   tol: float = 1e-4, sample_rows: int = 2000, checkpoint_passes: int = 10) -> list[Run]:
    """Every (k, start) run, in the order of ``ks``; ``inertia`` belongs to the
    final ``centres`` and the clusters of the last pass.  A run ends when its
    centres move by less than ``tol`` of the rows' spread.  ``max_passes``
    bounds the iterations, as in any k-means."""
    from pyspark.ml.functions import vector_to_array
    from tabsight.operators.cluster import to_vector
    ship_package(df.sparkSession)
    if max(ks, default=0) > MAX_K:
        raise ValueError(f"k above {MAX_K}")
    rows = to_vector(df, vec, "__v").select(vector_to_array("__v").alias("x")).where("x IS NOT NULL")
    sample = np.array([r["x"] for r in rows.orderBy(F.xxhash64("x"), "x").limit(sample_rows).collect()], float)
    if not len(sample):
        return []
    d, centre = sample.shape[1], sample.mean(axis=0)
    runs = [Run(k, sample_start(sample - centre, k, seed + s)) for k in ks for s in range(starts)]
    cells = sum(r.k for r in runs)
    first = np.cumsum([0] + [r.k for r in runs])
    state = spread(rows).mapInArrow(_opening(centre, len(runs), cells), STATE).persist()
    squares = rows.agg(F.sum(F.aggregate(F.zip_with("x", F.array(*[F.lit(float(c)) for c in centre]), lambda a, c: (a - c) * (a - c)),
                                         F.lit(0.0), lambda s, v: s + v)).alias("q"), F.count(F.lit(1)).alias("n")).first()
    limit = tol * np.sqrt(squares["q"] / squares["n"] / d)
    live, held = list(range(len(runs))), [state]
    for number in range(1, max_passes + 1):
        state = state.mapInArrow(_advance(runs, live, d), STATE)
        if number % checkpoint_passes == 0:
            state = cut_lineage(state)
        else:
            state = state.persist()
            held.append(state)
        total = tree_sum(state.select("sums").mapInArrow(_added, "x binary"))
        for old in held[:-2]:
            old.unpersist()
        held = held[-2:]
        sums = total[:cells * (1 + d)].reshape(cells, 1 + d)
        still = []
        for i in live:
            r, s = runs[i], sums[first[i]:first[i + 1]]
            new = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), r.centres)
            r.moved = np.sqrt(((new - r.centres) ** 2).sum(1))
            r.centres, r.passes = new, number
            r.inertia = float(max(0.0, squares["q"] - ((s[:, 1:] ** 2).sum(1) / np.maximum(s[:, 0], 1)).sum()))
            if r.moved.max() > limit:
                still.append(i)
        live = still
        if not live:
            break
    for old in held:
        old.unpersist()
    for r in runs:
        r.centres = r.centres + centre
    return runs


class Centres:
    """Result of k-means: cluster centres, their inertia, and ``transform``."""

    def __init__(self, run: Run, vec: str, out: str):
        self.centres, self.cost, self.vec, self.out = run.centres, run.inertia, vec, out

    @property
    def summary(self) -> Centres:
        return self

    @property
    def trainingCost(self) -> float:  # noqa: N802 - as Spark ML names it
        return self.cost

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - as Spark ML names it
        return list(self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        from tabsight.operators.cluster import to_array
        centres = self.centres

        @F.arrow_udf("int")
        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                x = _matrix(batch, centres.shape[1]) - centres.mean(0)
                parts = [_nearest(x[at:at + (1 << 15)], centres - centres.mean(0))[0] for at in range(0, len(x), 1 << 15)]
                yield pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32))
        ship_package(df.sparkSession)
        return to_array(df, self.vec, "__x").withColumn(self.out, nearest("__x")).drop("__x")
