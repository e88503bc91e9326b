"""Exact DBSCAN on a grid.

Points are bucketed on a grid over their first ``b = min(d, 3)``
coordinates.  Dropping coordinates never makes two points closer, so every
pair within ``eps`` lies in neighbouring cells: those are an equi-join on the
cell key after exploding a fixed list of offsets, never a cross join.

* **Core points**: with up to three dimensions a cell (side ``eps / √d``) has
  a diameter ≤ eps, so every point of a cell holding ≥ ``min_points`` points
  is core without any pair; only points of sparser cells count their
  neighbours, and whole sub-cells certainly within eps count at once.
* **Clusters**: connected components of core points linked within eps,
  by min-label propagation with label hops until nothing changes, with a
  reliable checkpoint each round to cut lineage.  Sub-cells that are neither
  certainly within nor certainly beyond eps are compared in NumPy groups of
  at most two parts of ``PART_POINTS`` points, one row out per group.
* **Border points** take the lowest cluster number among the cores within
  eps (the order in which clusters are grown from the lowest point index);
  the rest are noise (−1).  Clusters are numbered by their smallest core id.

With more dimensions grid cells separate nothing.  Points then belong to the
nearest of up to ``MAX_PIVOTS`` sampled pivots.  A cell's points are compared
with each other and with its halo: points of other cells that lie within eps
of the plane half-way between the two pivots, and within eps of the cell's
radius; no other point can have a neighbour in the cell.  Cell and halo are
cut into parts of ``PART_POINTS`` points, and each pair of parts is one group
whose distances are computed in NumPy; a group returns neighbour counts or a
spanning set of links (at most as many rows as it holds points), never its
pairs.  ``compared_pairs`` tells which share of all pairs is compared.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.operators.knn import distances
from tabsight.operators.ordered import dense_codes
from tabsight.operators.silhouette import matrix
from tabsight.session import cut_lineage

PART_POINTS = 2000
MAX_PIVOTS = 4096
GROUP = ["home", "home_part", "other", "other_part"]


def _dist2(a: str, b: str, d: int) -> Column:
    e = None
    for i in range(d):
        t = (F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i])
        e = t if e is None else e + t
    return e


def _sub_offsets(b: int, t: float, eps: float) -> list[tuple[int, ...]]:
    """Sub-cell offsets whose boxes can hold a pair within eps."""
    r = math.ceil(eps / t) + 1
    out = []
    for o in itertools.product(range(-r, r + 1), repeat=b):
        gap = sum((max(0, abs(v) - 1) * t) ** 2 for v in o)
        if gap <= eps * eps * (1 + 1e-12):
            out.append(o)
    return out


def _box_d2(p: str, sub: str, t: float, b: int, far: bool) -> Column:
    """Squared distance from point ``p`` to the box of sub-cell ``sub``:
    nearest (far=False) or farthest (far=True) corner distance."""
    e = None
    for i in range(b):
        lo = F.col(sub)[i] * t
        hi = (F.col(sub)[i] + 1) * t
        x = F.col(p)[i]
        if far:
            g = F.greatest(F.abs(x - lo), F.abs(x - hi))
        else:
            g = F.greatest(lo - x, x - hi, F.lit(0.0))
        e = g * g if e is None else e + g * g
    return e


def dbscan(df: DataFrame, id_col: str, vec_col: str, eps: float = 0.5, min_points: int = 5,
           sub: int = 4) -> DataFrame:
    """(id, cluster) with noise = −1.  ``vec_col``: array of numbers."""
    pts = df.select(F.col(id_col).alias("pid"),
                    F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    first = pts.select("v").first()
    spark = df.sparkSession
    if first is None:
        return spark.createDataFrame([], f"{id_col} {df.schema[id_col].dataType.simpleString()}, cluster int")
    d = len(first[0])
    b = min(d, 3)
    if b < d:
        return _dbscan_pivots(pts, id_col, eps, min_points)
    side = eps / math.sqrt(b)
    t = side / sub
    eps2 = eps * eps * (1 + 1e-12)
    subk = F.array(*[F.floor(F.col("v")[i] / t).cast("long") for i in range(b)])
    pts = pts.withColumn("sub", subk).withColumn(
        "cell", F.transform(F.col("sub"), lambda x: F.floor(x / F.lit(sub)).cast("long")))
    pts = cut_lineage(pts)
    offs = _sub_offsets(b, t, eps)
    off_arr = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offs])
    nb_sub = lambda c: F.transform(off_arr, lambda o: F.zip_with(c, o, lambda x, y: x + y))

    # ---- core points -------------------------------------------------------
    cell_n = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("cell_n"))
    pts = pts.join(cell_n, "cell")
    sub_n = pts.groupBy("sub").agg(F.count(F.lit(1)).alias("sub_n"))
    need = pts.where(F.col("cell_n") < min_points)        # cells too small to settle it
    probe = need.select("pid", "v", F.explode(nb_sub(F.col("sub"))).alias("sub"))
    pw = probe.join(sub_n, "sub")
    certain = pw.where(_box_d2("v", "sub", t, b, True) <= eps2).groupBy("pid").agg(F.sum("sub_n").alias("k1"))
    border = pw.where((_box_d2("v", "sub", t, b, True) > eps2) & (_box_d2("v", "sub", t, b, False) <= eps2))
    bpairs = (border.select(F.col("pid").alias("a"), F.col("v").alias("va"), "sub")
              .join(pts.select(F.col("v").alias("vb"), "sub"), "sub")
              .where(_dist2("va", "vb", d) <= eps2).groupBy(F.col("a").alias("pid")).agg(F.count(F.lit(1)).alias("k2")))
    k = (need.select("pid").join(certain, "pid", "left").join(bpairs, "pid", "left")
         .where(F.coalesce("k1", F.lit(0)) + F.coalesce("k2", F.lit(0)) >= min_points).select("pid"))
    core_ids = pts.where(F.col("cell_n") >= min_points).select("pid").unionByName(k)
    core = cut_lineage(pts.join(core_ids, "pid").select("pid", "v", "sub", "cell"))

    # ---- links between core cells (all cores of one cell are linked) -------
    node = F.concat_ws(",", F.col("cell").cast("array<string>"))
    core = core.withColumn("node", node)
    csub = core.groupBy("sub", "cell", "node").agg(F.min("pid").alias("first_pid"))
    probe_s = csub.select(F.col("sub").alias("su"), F.col("node").alias("na"),
                          F.explode(nb_sub(F.col("sub"))).alias("sub"))
    sp = probe_s.join(csub.select("sub", F.col("node").alias("nb")), "sub").where(F.col("na") != F.col("nb"))
    gap2, far2 = _sub_pair_d2("su", "sub", t, b)
    sure = sp.where(far2 <= eps2).select("na", "nb").distinct()
    # sure links first: points are compared only between sub-cells that these leave apart
    labels = cut_lineage(core.select("node").distinct().withColumn("lab", F.col("node")))
    labels = _propagate(labels, cut_lineage(sure))
    maybe = (sp.where((far2 > eps2) & (gap2 <= eps2)).select("na", "nb", F.col("su").alias("home"), F.col("sub").alias("other"))
             .join(labels.select(F.col("node").alias("na"), F.col("lab").alias("la")), "na")
             .join(labels.select(F.col("node").alias("nb"), F.col("lab").alias("lb")), "nb").where("la < lb"))
    maybe = cut_lineage(maybe.select("la", "lb", "home", "other").distinct())
    touching = _touching(core.select(F.col("sub").alias("cell"), "v"), maybe.select("home", "other").distinct(), eps, t, b)
    checked = maybe.join(touching, ["home", "other"]).select(F.col("la").alias("na"), F.col("lb").alias("nb")).distinct()
    edges = cut_lineage(checked.union(checked.select("nb", "na")))
    whole = _propagate(labels.select(F.col("lab").alias("node"), "lab").distinct(), edges)
    labels = labels.join(whole.select(F.col("node").alias("lab"), F.col("lab").alias("least")), "lab").select("node", F.col("least").alias("lab"))
    core_lab = core.join(_component_ids(core.select("pid", "node"), labels), "pid").select("pid", "v", "sub", "lab")

    # ---- border points: lowest cluster among cores within eps --------------
    lab_sub = core_lab.groupBy("sub").agg(F.min("lab").alias("sub_lab"))
    non_core = pts.join(core_ids, "pid", "left_anti").select("pid", "v", "sub")
    bp = non_core.select("pid", "v", F.explode(nb_sub(F.col("sub"))).alias("sub")).join(lab_sub, "sub")
    sure_b = bp.where(_box_d2("v", "sub", t, b, True) <= eps2).select("pid", F.col("sub_lab").alias("lab"))
    maybe_b = (bp.where((_box_d2("v", "sub", t, b, True) > eps2) & (_box_d2("v", "sub", t, b, False) <= eps2))
               .select(F.col("pid"), F.col("v").alias("va"), "sub")
               .join(core_lab.select("sub", F.col("v").alias("vb"), "lab"), "sub")
               .where(_dist2("va", "vb", d) <= eps2).select("pid", "lab"))
    border_lab = sure_b.unionByName(maybe_b).groupBy("pid").agg(F.min("lab").alias("lab"))
    return _number(pts.select("pid"), core_lab.select("pid", "lab").unionByName(border_lab), id_col)


def _sub_pair_d2(a: str, b_: str, t: float, b: int):
    gap, far = None, None
    for i in range(b):
        dlt = F.abs(F.col(a)[i] - F.col(b_)[i])
        g = F.greatest(dlt - 1, F.lit(0)) * t
        f = (dlt + 1) * t
        gap = g * g if gap is None else gap + g * g
        far = f * f if far is None else far + f * f
    return gap, far


def _propagate(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: every node ends labelled with the smallest node
    id of its component.  Each round takes the smallest label among the
    neighbours, then jumps one hop along the labels (a label is itself a
    node), which roughly halves long chains per round.  Lineage is cut by a
    reliable checkpoint every round."""
    while True:
        prop = (edges.join(labels.withColumnRenamed("node", "na"), "na")
                .groupBy(F.col("nb").alias("node")).agg(F.min("lab").alias("cand")))
        step = labels.join(prop, "node", "left").select("node", F.least("lab", F.coalesce("cand", "lab")).alias("lab"))
        hop = step.select(F.col("node").alias("lab"), F.col("lab").alias("lab2"))
        new = cut_lineage(step.join(hop, "lab", "left")
                          .select("node", F.least("lab", F.coalesce("lab2", "lab")).alias("lab")))
        changed = (new.join(labels.withColumnRenamed("lab", "old"), "node")
                   .where(F.col("lab") != F.col("old")).limit(1).count())
        labels = new
        if changed == 0:
            return labels


def _component_ids(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(pid, lab) with lab = smallest core id of the pid's component."""
    j = members.join(labels, "node")
    first = j.groupBy(F.col("lab").alias("comp")).agg(F.min("pid").alias("cid"))
    return j.join(first, j["lab"] == first["comp"]).select("pid", F.col("cid").alias("lab"))


def _number(all_ids: DataFrame, assigned: DataFrame, id_col: str) -> DataFrame:
    """Clusters numbered 0.. by their smallest core id; others −1."""
    codes = dense_codes(assigned, "lab").select(F.col("value").alias("lab"), F.col("code").alias("cluster"))
    return (all_ids.join(assigned, "pid", "left").join(codes, "lab", "left")
            .select(F.col("pid").alias(id_col), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")))


def _pair_groups(pts: DataFrame, pairs: DataFrame, hash_col: str, within, first: bool) -> DataFrame:
    """``pts`` (cell, …) cut into parts of about ``PART_POINTS`` by a hash of
    ``hash_col``; every point once for each part of each cell that ``pairs``
    (home, other) puts it together with, as a member of a (home part, other
    part) group: ``side`` 0 as a home point, 1 as the other.  Points for which
    ``within`` (name of the cell's column) is false are left out.  ``first``:
    the group of the two first parts only, else all others."""
    parts = pts.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_POINTS).cast("int").alias("parts"))
    near = (pairs.join(parts.withColumnsRenamed({"cell": "home", "parts": "home_parts"}), "home")
            .join(parts.withColumnsRenamed({"cell": "other", "parts": "other_parts"}), "other"))
    mine = pts.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(hash_col), F.col("parts")).cast("int")).drop("parts")
    cols = [c for c in pts.columns if c != "cell"]

    def dealt(own: str, across: str, side: int) -> DataFrame:
        rows = mine.withColumnsRenamed({"cell": own, "part": f"{own}_part"}).join(near, own).where(within(across))
        if first:
            rows = rows.where(F.col(f"{own}_part") == 0).withColumn(f"{across}_part", F.lit(0))
        else:
            rows = rows.withColumn(f"{across}_part", F.explode(F.sequence(F.lit(0), F.col(f"{across}_parts") - 1)))
            rows = rows.where("home_part > 0 OR other_part > 0")
        return rows.select(*GROUP, *cols, F.lit(side).alias("side"))
    return dealt("home", "other", 0).unionByName(dealt("other", "home", 1))


def _neighbour_pairs(pts: DataFrame, offs: list[tuple[int, ...]]) -> DataFrame:
    """(home, other): every cell with each of its occupied neighbours."""
    cells = pts.select("cell").distinct()
    off_arr = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offs])
    return (cells.select(F.col("cell").alias("home"), F.explode(
        F.transform(off_arr, lambda o: F.zip_with(F.col("cell"), o, lambda x, y: x + y))).alias("other"))
        .join(cells.withColumnRenamed("cell", "other"), "other"))


def _touching(pts: DataFrame, pairs: DataFrame, eps: float, t: float, b: int) -> DataFrame:
    """The (home, other) of ``pairs`` that hold two points within eps.  Only
    places that occur, and only those within eps of the other cell's box, are
    compared: first one part of each side, which settles nearly all pairs of
    dense cells, then the other pairs in full."""
    eps2 = eps * eps * (1 + 1e-12)
    cells = pairs.select(F.col("home").alias("cell")).union(pairs.select("other")).distinct()
    pts = cut_lineage(pts.join(cells, "cell", "left_semi").distinct())

    def within(cell: str) -> Column:
        return _box_d2("v", cell, t, b, False) <= eps2 * (1 + 1e-6)

    def any_near(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, near = _sides(pdf, eps2)
        return pdf[["home", "other"]].iloc[:1] if near.any() else pdf[["home", "other"]].iloc[:0]

    def found(groups):
        return groups.groupBy(*GROUP).applyInPandas(any_near, "home array<long>, other array<long>").distinct()
    first = cut_lineage(found(_pair_groups(pts, pairs, "v", within, True)))
    rest = pairs.join(first, ["home", "other"], "left_anti")
    return first.unionByName(found(_pair_groups(pts, rest, "v", within, False)))


def _sides(pdf: pd.DataFrame, eps2: float):
    """(home rows, other rows, which pairs are within eps)"""
    a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if not len(a) or not len(b):
        return a, b, np.zeros((len(a), len(b)), bool)
    X, Y = (np.stack(x["v"].to_numpy()).astype("float64") for x in (a, b))
    centre = Y.mean(axis=0)
    return a, b, distances(X - centre, Y - centre) ** 2 <= eps2


def _count_near(eps2: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, _, near = _sides(pdf, eps2)
        return pd.DataFrame({"pid": a["pid"], "k": near.sum(axis=1).astype("int64")})
    return run


def _link_near(eps2: float):
    """Links that connect what all links among the group's cores connect, and
    for each border point one core of each connected set it touches."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, near = _sides(pdf, eps2)
        ids_a, ids_b = a["pid"].to_numpy(), b["pid"].to_numpy()
        core_a, core_b = a["core"].to_numpy(dtype=bool), b["core"].to_numpy(dtype=bool)
        names = {p: i for i, p in enumerate(dict.fromkeys([*ids_a.tolist(), *ids_b.tolist()]))}
        up = list(range(len(names)))

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i
        at_a, at_b = [names[p] for p in ids_a.tolist()], [names[p] for p in ids_b.tolist()]
        out = []
        for i in np.flatnonzero(core_a):
            for j in np.flatnonzero(near[i] & core_b):
                x, y = find(at_a[i]), find(at_b[j])
                if x != y:
                    up[x] = y
                    out.append((ids_a[i], ids_b[j], True))
        for i in np.flatnonzero(~core_a):
            seen = set()
            for j in np.flatnonzero(near[i] & core_b):
                root = find(at_b[j])
                if root not in seen:
                    seen.add(root)
                    out.append((ids_a[i], ids_b[j], False))
        return pd.DataFrame(out, columns=["na", "nb", "core"])
    return run


# ------------------------------------------------------- more than 3 dimensions
def _assigned(pts: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``pts`` with the number of the nearest pivot (the first of equals) and
    the distance to it."""
    def run(batches):
        step = max(1, (1 << 22) // len(pivots))
        for batch in batches:
            x = matrix(batch.column(1), pivots.shape[1])
            d = [distances(x[at:at + step], pivots) for at in range(0, len(x), step)]
            home = np.concatenate([v.argmin(1) for v in d]) if d else np.zeros(0, np.int64)
            near = np.concatenate([v.min(1) for v in d]) if d else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(near)],
                                             names=["pid", "v", "cell", "dist"])
    kind = pts.schema["pid"].dataType.simpleString()
    return cut_lineage(pts.select("pid", "v").mapInArrow(run, f"pid {kind}, v array<double>, cell int, dist double"))


def _halo(assigned: DataFrame, pivots: np.ndarray, radius: np.ndarray, eps: float) -> DataFrame:
    """Each point once for every other cell in whose halo it lies."""
    apart = distances(pivots, pivots)
    reach = eps * (1 + 1e-9) + 1e-12

    def run(batches):
        step = max(1, (1 << 22) // len(pivots))
        for batch in batches:
            x, own = matrix(batch.column(1), pivots.shape[1]), batch.column(2).to_numpy()
            cells = []
            for at in range(0, len(x), step):
                d, home = distances(x[at:at + step], pivots), own[at:at + step]
                rows = np.arange(len(d))
                gap = apart[home]
                with np.errstate(divide="ignore", invalid="ignore"):
                    beyond = (d * d - (d[rows, home] ** 2)[:, None]) / (2 * gap)  # distance to the half-way plane
                near = (np.where(gap > 0, beyond, 0.0) <= reach) & (d <= radius[None] + reach)
                near[rows, home] = False
                cells += [np.flatnonzero(v).astype(np.int32) for v in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32()))],
                                             names=["pid", "v", "cells"])
    kind = assigned.schema["pid"].dataType.simpleString()
    made = assigned.select("pid", "v", "cell").mapInArrow(run, f"pid {kind}, v array<double>, cells array<int>")
    return made.select("pid", "v", F.explode("cells").alias("cell"))


def pivot_cells(pts: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """(homes, others): (pid, v, cell) of every point in its own cell, and of
    every point in all cells where it must be compared."""
    n = pts.count()
    wanted = max(1, min(MAX_PIVOTS, 4 * n // PART_POINTS))
    drawn = F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 8 * wanted / max(1, n)))
    sample = pts.where(drawn).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    pivots = np.array([r["v"] for r in sample or [pts.first()]], float)
    assigned = _assigned(pts, pivots)
    radius = np.full(len(pivots), -np.inf)
    for cell, far in assigned.groupBy("cell").agg(F.max("dist")).collect():  # one row per pivot
        radius[cell] = far
    homes = assigned.select("pid", "v", "cell")
    return homes, cut_lineage(homes.unionByName(_halo(assigned, pivots, radius, eps)))


def compared_pairs(df: DataFrame, id_col: str, vec_col: str, eps: float = 0.5) -> DataFrame:
    """(n, compared, share): how many ordered pairs of points ``dbscan``
    compares in more than three dimensions, and their share of all."""
    pts = df.select(F.col(id_col).alias("pid"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    homes, others = pivot_cells(pts, eps)
    a, b = (x.groupBy("cell").agg(F.count(F.lit(1)).alias(c)) for x, c in ((homes, "a"), (others, "b")))
    total = a.join(b, "cell").agg(F.sum("a").alias("n"), F.sum(F.col("a") * F.col("b")).alias("compared"))
    return total.select("n", "compared", (F.col("compared") / (F.col("n") * F.col("n"))).alias("share"))


def _tile_groups(homes: DataFrame, others: DataFrame) -> DataFrame:
    """Groups (cell, home part, other part) with ``side`` 0 and 1."""
    sizes = [x.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_POINTS).cast("int").alias(c))
             for x, c in ((homes, "home_parts"), (others, "other_parts"))]
    parts = sizes[0].join(sizes[1], "cell")
    cols = [c for c in homes.columns if c != "cell"]

    def dealt(rows: DataFrame, own: str, all_of: str, side: int) -> DataFrame:
        part = F.pmod(F.xxhash64("pid"), F.col(f"{own}s")).cast("int")
        return (rows.join(parts, "cell").withColumn(own, part)
                .withColumn(all_of, F.explode(F.sequence(F.lit(0), F.col(f"{all_of}s") - 1)))
                .select(F.col("cell").alias("home"), "home_part", F.col("cell").alias("other"), "other_part", *cols,
                        F.lit(side).alias("side")))
    return dealt(homes, "home_part", "other_part", 0).unionByName(dealt(others, "other_part", "home_part", 1))


def _dbscan_pivots(pts: DataFrame, id_col: str, eps: float, min_points: int) -> DataFrame:
    """d > 3: cells of pivots with their halos, see the module's docstring."""
    eps2 = eps * eps * (1 + 1e-12)
    kind = pts.schema["pid"].dataType.simpleString()
    homes, others = pivot_cells(pts, eps)
    counts = (_tile_groups(homes, others).groupBy(*GROUP).applyInPandas(_count_near(eps2), f"pid {kind}, k long")
              .groupBy("pid").agg(F.sum("k").alias("k")))
    core_ids = cut_lineage(counts.where(F.col("k") >= min_points).select("pid", F.lit(True).alias("core")))

    def flagged(rows: DataFrame, how: str) -> DataFrame:
        return rows.join(core_ids, "pid", how).withColumn("core", F.coalesce("core", F.lit(False)))
    # every point needs the cores near it, and only these
    links = cut_lineage(_tile_groups(flagged(homes, "left"), flagged(others, "inner")).groupBy(*GROUP).applyInPandas(
        _link_near(eps2), f"na {kind}, nb {kind}, core boolean"))
    cores = core_ids.select("pid")
    text = [F.col(c).cast("string").alias(c) for c in ("na", "nb")]
    edges = links.where("core").select(*text)
    edges = cut_lineage(edges.union(edges.select("nb", "na")).distinct())
    labels = _propagate(cores.select(F.col("pid").cast("string").alias("node"), F.col("pid").cast("string").alias("lab")), edges)
    core_lab = _component_ids(cores.select("pid", F.col("pid").cast("string").alias("node")), labels)
    border = (links.where("NOT core").join(core_lab.select(F.col("pid").alias("nb"), "lab"), "nb")
              .groupBy(F.col("na").alias("pid")).agg(F.min("lab").alias("lab")))
    return _number(pts.select("pid"), core_lab.unionByName(border), id_col)
