"""Approximate nearest neighbours by multi-probe random projections (M4).

Each of ``tables`` tables cuts the space with random hyperplanes through the
training rows' mean; a row's bucket is the pattern of sides.  A query looks
into its own bucket and into those reached by crossing the planes it lies
nearest to (``probes`` buckets per table, least crossing distance first), so
few tables give a high recall.  Queries meet training rows by an equi-join on
(table, bucket) whose groups are split on both sides into parts of about
``max_group`` rows; a group computes exact distances in NumPy and returns the
k best per query, and the parts are merged by exact distance.

The answer is exact among the rows met; ``recall`` measures it against
``knn_neighbours``, and ``candidates`` counts the rows met.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.operators.knn import _as_double_array, _local_topk, knn_neighbours
from tabsight.operators.silhouette import matrix
from tabsight.session import cut_lineage, ship_package, spread

KEY = ["table", "bucket", "t_part", "q_part"]


def cheapest_flips(cost: np.ndarray, n: int) -> list[int]:
    """Bit masks of the ``n`` subsets of least total cost, the empty one first."""
    order = np.argsort(cost, kind="stable").tolist()
    out, heap = [0], [(float(cost[order[0]]), (0,))] if len(order) else []
    while heap and len(out) < n:
        total, chosen = heapq.heappop(heap)
        out.append(sum(1 << order[i] for i in chosen))
        last = chosen[-1]
        if last + 1 < len(order):  # shift the last member, or add the next one
            step = float(cost[order[last + 1]])
            heapq.heappush(heap, (total - float(cost[order[last]]) + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + step, (*chosen, last + 1)))
    return out


def _buckets(planes: np.ndarray, centre: np.ndarray, probes: int):
    """(id, vector, table, bucket) of each row; with more probes a row is in
    several buckets of a table.  ``planes``: tables x bits x d."""
    tables, bits, _ = planes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(part.column(1), len(centre)) - centre
                side = np.einsum("nd,tbd->ntb", x, planes)
                own = ((side > 0) << np.arange(bits)).sum(axis=2)
                if probes == 1:
                    found = own.reshape(-1, 1)
                else:
                    masks = [cheapest_flips(c, probes) for c in (side * side).reshape(-1, bits)]
                    found = own.reshape(-1, 1) ^ np.array(masks)
                row = np.repeat(np.arange(len(x)), tables * found.shape[1])
                table = np.tile(np.repeat(np.arange(tables), found.shape[1]), len(x))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                                                  pa.array(table.astype(np.int32)), pa.array(found.ravel())],
                                                 names=["id", "v", "table", "bucket"])
    return run


def _met(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, tables: int, probes: int, bucket_rows: int,
         max_group: int, seed: int):
    """(training rows, query rows) by group, and the training rows' mean."""
    ship_package(train.sparkSession)
    idt = train.schema[id_col].dataType.simpleString()
    tr, te = (x.select(F.col(id_col).alias("id"), _as_double_array(F.col(vec_col)).alias("v")) for x in (train, test))
    first = tr.first()
    if first is None:
        return None
    d, n = len(first["v"]), tr.count()
    centre = np.array(tr.agg(*[F.avg(F.get("v", F.lit(i))) for i in range(d)]).first(), float)
    bits = max(1, min(62, round(math.log2(max(2, n / bucket_rows)))))
    planes = np.random.default_rng(seed).standard_normal((tables, bits, d))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    schema = f"id {idt}, v array<double>, `table` int, bucket long"
    t = cut_lineage(spread(tr).mapInArrow(_buckets(planes, centre, 1), schema))
    q = cut_lineage(spread(te).mapInArrow(_buckets(planes, centre, min(probes, 1 << bits)), schema))
    sizes = [x.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / max_group).cast("int").alias(c))
             for x, c in ((t, "t_parts"), (q, "q_parts"))]
    both = sizes[0].join(sizes[1], ["table", "bucket"])

    def dealt(rows: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int")
        return (rows.join(both, ["table", "bucket"]).withColumn(own, part)
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
                .select(*KEY, F.col("id").alias(names[0]), F.col("v").alias(names[1])))
    return dealt(t, "t_part", "q_part", ("t_id", "t_vec")), dealt(q, "q_part", "t_part", ("q_id", "q_vec")), centre


def ann_neighbours(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, k: int = 5, tables: int = 12,
                   probes: int = 16, bucket_rows: int = 64, max_group: int = 20_000, seed: int = 42) -> DataFrame:
    """(id, neighbour_id, dist, rank): the ``k`` nearest of the training rows
    that a query meets (ties by training id); fewer if it meets fewer.
    ``bucket_rows`` is the size of an even bucket, ``max_group`` that of the
    parts a bucket is split into: neither limits neighbours."""
    idt = train.schema[id_col].dataType.simpleString()
    met = _met(train, test, id_col, vec_col, tables, probes, bucket_rows, max_group, seed)
    if met is None:
        return train.sparkSession.createDataFrame([], f"`{id_col}` {idt}, neighbour_id {idt}, dist double, rank int")
    t_rows, q_rows, centre = met
    local = (q_rows.groupBy(*KEY).cogroup(t_rows.groupBy(*KEY))
             .applyInPandas(_local_topk(centre, k), f"q_id {idt}, t_id {idt}, dist double"))
    once = local.groupBy("q_id", "t_id").agg(F.min("dist").alias("dist"))
    w = Window.partitionBy("q_id").orderBy("dist", "t_id")  # at most k rows per bucket looked into
    return (once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("q_id").alias(id_col), F.col("t_id").alias("neighbour_id"), "dist", "rank"))


def candidates(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, tables: int = 12, probes: int = 16,
               bucket_rows: int = 64, max_group: int = 20_000, seed: int = 42) -> DataFrame:
    """(id, candidates): how many distances a query computes (a training row
    counts once for each bucket it is met in)."""
    idt = train.schema[id_col].dataType.simpleString()
    met = _met(train, test, id_col, vec_col, tables, probes, bucket_rows, max_group, seed)
    if met is None:
        return train.sparkSession.createDataFrame([], f"`{id_col}` {idt}, candidates long")
    t_rows, q_rows, _ = met
    sizes = t_rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return q_rows.join(sizes, KEY, "left").groupBy(F.col("q_id").alias(id_col)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("candidates"))


def recall(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, k: int = 5, **options) -> DataFrame:
    """(n_queries, recall): share of the exact neighbours that are found."""
    exact = knn_neighbours(train, test, id_col, vec_col, k).select(id_col, "neighbour_id")
    found = ann_neighbours(train, test, id_col, vec_col, k, **options).select(id_col, "neighbour_id", F.lit(1).alias("hit"))
    joined = exact.join(found, [id_col, "neighbour_id"], "left")
    return joined.agg(F.countDistinct(id_col).alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
