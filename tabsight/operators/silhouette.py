"""Mean silhouette with Euclidean distances, exact (C4).

Distances do not sum in closed form, so pairs of rows must be compared, but
few of them decide: the mean distance from x to the rows of a cluster C lies
between the distance to its centroid and the root of the mean squared
distance (both by Jensen's inequality), and the latter has a closed form over
per-cluster sums.  A cluster whose lower bound is above the least upper bound
of the other clusters cannot be the nearest one, so a row is compared with its
own cluster and with the few that remain.

The comparisons are dealt to tiles (cluster, part of its rows, part of the
rows that need it), each of at most about ``tile_rows`` x ``tile_rows`` pairs,
so a cluster of any size is split on both sides.  A task holds the members of
one tile and streams the rows against them; partial sums per (row, cluster)
are added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.cluster import CELLS, MAX_CLUSTERS, _cluster_table, _real, to_array
from tabsight.session import cut_lineage, ship_package

SLACK = 1e-9  # relative widening of the bounds against rounding
BLOCK = 1 << 17  # distances made at a time in a tile: a block stays in the processor's cache


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances; pairs so near that the product form loses digits
    are taken from their differences."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return _distances(x, xx, y, yy)


def _distances(x: np.ndarray, xx: np.ndarray, y: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """``distances`` with the rows' squared lengths given."""
    d = x @ y.T
    d *= -2
    d += xx[:, None]
    d += yy
    # no pair is nearer than this share of the longest rows' lengths, or each pair is looked at
    if d.size and not d.min() >= 1e-6 * (xx.max() + yy.max()):
        i, j = np.nonzero(d < 1e-6 * (xx[:, None] + yy[None, :]))
        d[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
        np.maximum(d, 0.0, out=d)
    return np.sqrt(d, out=d)


def distance_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the Euclidean distances of each row of ``x`` to those of ``y``,
    in blocks of both."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    wide = min(len(y), 1024)
    high = max(1, BLOCK // max(1, wide))
    out = np.zeros(len(x))
    for i in range(0, len(x), high):
        for j in range(0, len(y), wide):
            out[i:i + high] += _distances(x[i:i + high], xx[i:i + high], y[j:j + wide], yy[j:j + wide]).sum(axis=1)
    return out


def _needed(centre, index, n, s, q, label_at: int):
    """Each row with its own cluster's number and the clusters to compare with."""
    means = s / n[:, None]
    mean_sq = q / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // (len(n) * max(1, len(centre))))
        for batch in batches:
            x = matrix(batch.column(1), len(centre)) - centre
            own = np.array([index[v] for v in batch.column(label_at).to_pylist()])
            need = []
            for at in range(0, len(x), step):
                part, mine = x[at:at + step], own[at:at + step]
                rows = np.arange(len(part))
                low = distances(part, means)
                high = np.sqrt(np.maximum((part * part).sum(axis=1)[:, None] - 2 * part @ means.T + mean_sq[None, :], low ** 2))
                high[rows, mine] = np.inf
                keep = low <= high.min(axis=1, keepdims=True) * (1 + SLACK) + SLACK
                keep[rows, mine] = True
                need += [np.flatnonzero(k).astype(np.int32) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own.astype(np.int32)), pa.array(need, pa.list_(pa.int32())),
                 pa.array(list(x), pa.list_(pa.float64()))], names=["r", "own", "need", "x"])
    return run


def _tiles(dim: int):
    """Rows of a tile are neighbours, members (role 0) first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, y = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("c", "chunk", "part")], axis=1)
            role, r, x = batch.column("role").to_numpy(), batch.column("r"), matrix(batch.column("x"), dim)
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                if key != tuple(keys[a]):
                    key, held, y = tuple(keys[a]), [], None
                if role[a] == 0:
                    held.append(x[a:b])
                    continue
                if y is None:
                    y = np.concatenate(held)
                sums = distance_sums(x[a:b], y)
                yield pa.RecordBatch.from_arrays([r.slice(a, b - a), pa.array(keys[a:b, 0].astype(np.int32)), pa.array(sums)],
                                                 names=["r", "c", "s"])
    return run


def silhouette(df: DataFrame, vec: str, label: str, by_point: bool = False, noise=None, tile_rows: int = 8192,
               max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """(silhouette, n_clusters): the mean over all rows of (b - a) / max(a, b)
    with a the mean distance to the other rows of the own cluster and b that
    to the nearest other cluster; a row alone in its cluster scores 0; fewer
    than two clusters besides ``noise`` give -1.  ``by_point``: (label, s),
    one row per row.  NULL labels are a cluster like any other."""
    spark = df.sparkSession
    ship_package(spark)
    rows = cut_lineage(to_array(df, vec, "__x").select(F.monotonically_increasing_id().alias("r"), "__x", label))
    centre, labels, n, s, q = _cluster_table(rows, "__x", label, max_clusters)
    k_real = _real(labels, noise)
    if k_real < 2:
        return spark.createDataFrame([(-1.0, k_real)], "silhouette double, n_clusters int")
    index = {lab: i for i, lab in enumerate(labels)}
    needed = cut_lineage(rows.select("r", "__x", label).mapInArrow(
        _needed(centre, index, n, s, q, 2), "r long, own int, need array<int>, x array<double>"))
    wanted = dict(needed.select(F.explode("need").alias("c")).groupBy("c").count().collect())  # one row per cluster
    sizes = spark.createDataFrame(
        [(i, int(n[i]), -(-int(n[i]) // tile_rows), -(-wanted.get(i, 0) // tile_rows)) for i in range(len(labels))],
        "c int, n long, chunks int, parts int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def part_of(count: str):
        return F.pmod(F.xxhash64("r"), F.col(count)).cast("int")
    members = (needed.select(F.col("own").alias("c"), "r", "x").join(F.broadcast(sizes), "c")
               .select("c", part_of("chunks").alias("chunk"), every("parts").alias("part"), F.lit(0).alias("role"), "r", "x"))
    probes = (needed.select(F.explode("need").alias("c"), "r", "x").join(F.broadcast(sizes), "c")
              .select("c", every("chunks").alias("chunk"), part_of("parts").alias("part"), F.lit(1).alias("role"), "r", "x"))
    tiles = members.unionByName(probes).repartition("c", "chunk", "part").sortWithinPartitions("c", "chunk", "part", "role")
    sums = tiles.mapInArrow(_tiles(len(centre)), "r long, c int, s double").groupBy("r", "c").agg(F.sum("s").alias("s"))
    scored = sums.join(F.broadcast(sizes.select("c", "n")), "c").join(needed.select("r", "own"), "r")
    mine = F.col("c") == F.col("own")
    per = scored.groupBy("r").agg(
        F.max(F.when(mine & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"))
    most = F.greatest("a", "b")
    per = per.select("r", F.when(F.col("a").isNotNull() & (most > 0), (F.col("b") - F.col("a")) / most).otherwise(0.0).alias("s"))
    if by_point:
        return per.join(rows.select("r", label), "r").select(label, "s")
    return per.agg(F.avg("s").alias("silhouette"), F.lit(k_real).alias("n_clusters"))
