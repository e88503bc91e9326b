"""Isolation forest.

* **Samples**: one seeded hash of a row's id says how many trees it is drawn
  for (binomial, sized for ~3 × sample rows per tree); rows drawn for none
  stop there, the others step with a hashed stride through the trees from a
  hashed first one, and each tree keeps its ``sample_size`` smallest hashes —
  repeatable, independent of partitioning, and no row is copied to trees it
  is not in.
* **Fit**: ``groupBy(tree).applyInPandas`` grows each tree (≤ 2·sample − 1
  nodes) from its own bounded sample.
* **Score**: the node tables (trees × nodes, bounded by the parameters) are
  shipped to a ``mapInPandas`` scorer that walks all trees for a batch of
  rows with NumPy; score s = 2^(−E[h(x)] / c(sample)).
* **Flag**: rows above the (1 − contamination) quantile of s.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.functions.exprs import num
from tabsight.operators.features import impute_median
from tabsight.session import cut_lineage, spread

EULER = 0.5772156649015329


def c_factor(m: float) -> float:
    """Average path length of an unsuccessful search in a BST of m points."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1) + EULER) - 2.0 * (m - 1) / m


def binomial_cumulative(n: int, p: float) -> list[float]:
    """P(at most k successes of n) for k = 0 … n − 1."""
    if p >= 1.0:
        return [0.0] * n
    out, term, total = [], (1.0 - p) ** n, 0.0
    for k in range(n):
        total += term
        out.append(total)
        term *= (n - k) / (k + 1) * p / (1.0 - p)
    return out


def _grow(cols: list[str], sample_size: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(sample_size, 2))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100_003 + tree)
        X = pdf[cols].to_numpy(dtype="float64")
        nodes = []  # node, feature, threshold, left, right, size

        def build(idx, depth):
            me = len(nodes)
            nodes.append([me, -1, 0.0, -1, -1, len(idx)])
            if depth >= max_depth or len(idx) <= 1:
                return me
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if len(usable) == 0:
                return me
            f = int(rng.choice(usable))
            thr = float(rng.uniform(lo[f], hi[f]))
            left = idx[sub[:, f] < thr]
            right = idx[sub[:, f] >= thr]
            nodes[me][1], nodes[me][2] = f, thr
            nodes[me][3] = build(left, depth + 1)
            nodes[me][4] = build(right, depth + 1)
            return me

        build(np.arange(len(X)), 0)
        a = np.array(nodes, dtype="float64")
        return pd.DataFrame({"tree": tree, "node": a[:, 0].astype("int32"), "feature": a[:, 1].astype("int32"),
                             "threshold": a[:, 2], "left": a[:, 3].astype("int32"), "right": a[:, 4].astype("int32"),
                             "size": a[:, 5].astype("int32")})
    return fit


def _scorer(trees: dict, cols: list[str], id_col: str, sample_size: int):
    norm = c_factor(sample_size)
    packed = []
    for t in sorted(trees):
        nd = trees[t]
        leaf_extra = np.array([c_factor(s) for s in nd["size"]])
        packed.append((nd["feature"], nd["threshold"], nd["left"], nd["right"], leaf_extra))

    def run(batches):
        for b in batches:
            if len(b) == 0:
                continue
            X = b[cols].to_numpy(dtype="float64")
            total = np.zeros(len(X))
            rows = np.arange(len(X))
            for feat, thr, left, right, extra in packed:
                node = np.zeros(len(X), dtype="int64")
                depth = np.zeros(len(X))
                active = feat[node] >= 0
                while active.any():
                    f = feat[node[active]]
                    go_left = X[rows[active], f] < thr[node[active]]
                    node[active] = np.where(go_left, left[node[active]], right[node[active]])
                    depth[active] += 1
                    active = feat[node] >= 0
                total += depth + extra[node]
            mean_h = total / len(packed)
            s = np.power(2.0, -mean_h / norm) if norm > 0 else np.full(len(X), 0.5)
            yield pd.DataFrame({id_col: b[id_col], "score": s})
    return run


def isolation_forest(df: DataFrame, id_col: str, cols: list[str], n_trees: int = 100,
                     sample_size: int = 256, contamination: float = 0.05, seed: int = 42,
                     exact_threshold: bool = True) -> DataFrame:
    """(id, score, is_anomaly) for every row; missing values median-filled."""
    x = impute_median(df.select(id_col, *[num(df, c).alias(c) for c in cols]), cols)
    n = x.count()
    psi = max(1, min(sample_size, n))
    frac = min(1.0, 3.0 * psi / max(n, 1))
    # how many trees a row joins is binomial(n_trees, frac): one hash against
    # the cumulative probabilities, and rows of no tree go no further.  A row
    # that joins k trees takes k steps of a hashed stride, coprime to their
    # number, from a hashed first tree: only drawn pairs are made, all in
    # generated code.
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    steps = [float(c) for c in binomial_cumulative(n_trees, frac)]
    more = [c for c in steps[1:] if c < 1 - 1e-13]
    joins = sum(((F.col("__u") >= F.lit(c)).cast("int") for c in more), F.lit(1))
    strides = [t for t in range(1, n_trees + 1) if math.gcd(t, n_trees) == 1]
    first = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(n_trees))
    stride = F.get(F.array(*map(F.lit, strides)), F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 2)), F.lit(len(strides))).cast("int"))
    cand = (x.withColumn("__u", u).where(F.col("__u") >= F.lit(steps[0]))
            .select(id_col, *cols, first.alias("__first"), stride.alias("__stride"),
                    F.explode(F.sequence(F.lit(0), joins - 1)).alias("__step"))
            .withColumn("tree", F.pmod(F.col("__first") + F.col("__step") * F.col("__stride"), F.lit(n_trees)).cast("int"))
            .drop("__first", "__stride", "__step")
            .withColumn("__h", F.xxhash64(F.col(id_col), F.lit(seed + 3), F.col("tree"))))
    w = Window.partitionBy("tree").orderBy("__h", id_col)  # ~3·sample rows per tree
    sample = cand.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= psi).drop("__rn", "__h")
    nodes = sample.groupBy("tree").applyInPandas(
        _grow(cols, psi, seed),
        "tree int, node int, feature int, threshold double, left int, right int, size int")
    # bounded: n_trees × (2·sample − 1) node rows
    pdf = nodes.toPandas()
    trees = {}
    for t, g in pdf.groupby("tree"):
        g = g.sort_values("node")
        trees[int(t)] = {k: g[k].to_numpy() for k in ["feature", "threshold", "left", "right", "size"]}
    idt = x.schema[id_col].dataType.simpleString()
    # scores feed the threshold and the flags: score once, keep them
    scored = cut_lineage(spread(x).mapInPandas(_scorer(trees, cols, id_col, psi), f"{id_col} {idt}, score double"))
    from tabsight.operators.profile import quantile_row
    q = 1.0 - contamination
    thr = quantile_row(scored, {"s": F.col("score")}, [q], True if exact_threshold else False).select(
        F.col("s__q0").alias("__thr"))
    return scored.crossJoin(F.broadcast(thr)).select(
        id_col, "score", (F.col("score") > F.col("__thr")).alias("is_anomaly"))


def anomaly_summary(flags: DataFrame, digits: int = 4) -> DataFrame:
    return flags.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                     F.sum(F.col("is_anomaly").cast("long")).cast("bigint").alias("n_anomalies")).select(
        "n_rows", "n_anomalies", F.round(F.col("n_anomalies") * 100.0 / F.col("n_rows"), digits).alias("pct"))
