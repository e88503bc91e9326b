"""Shapley values of any model by weighted least squares over coalitions.

A coalition keeps some of a row's features and takes the others from each of
a few background rows; its value is the mean output.  The attributions are
the weighted least-squares fit of these values with the Shapley kernel as
weights, under the constraint that they add up to output minus mean
background output.  All rows share the coalitions, so they share the normal
equations: the solution is one matrix from coalition values to attributions,
and a row's attributions are sums of (matrix entry x output), which Spark
combines before its shuffle.  With all coalitions (few features) the values
are exact.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalitions(d: int, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(masks, weights) of at most about ``n`` coalitions of ``d`` features,
    without the empty and the full one.  Sizes are taken whole, smallest with
    largest, while they fit; the rest of ``n`` is drawn from the other sizes
    by their kernel weight, each with its complement."""
    masks, weights = [], []
    sizes = list(range(1, d))
    mass = {k: (d - 1) / (k * (d - k)) for k in sizes}  # of all coalitions of a size
    open_sizes = set(sizes)
    for k in range(1, d // 2 + 1):
        both = {k, d - k}
        count = sum(comb(d, s) for s in both)
        if len(masks) + count > n:
            break
        for s in sorted(both):
            for chosen in combinations(range(d), s):
                masks.append(np.isin(np.arange(d), chosen))
                weights.append(mass[s] / comb(d, s))
        open_sizes -= both
    left = (n - len(masks)) // 2
    if open_sizes and left > 0:
        rng = np.random.default_rng(seed)
        size_list = sorted(open_sizes)
        total = sum(mass[s] for s in size_list)
        for s in rng.choice(size_list, left, p=[mass[s] / total for s in size_list]).tolist():
            mask = np.isin(np.arange(d), rng.choice(d, s, replace=False))
            masks += [mask, ~mask]
            weights += [total / (2 * left)] * 2
    return np.array(masks, bool).reshape(-1, d), np.array(weights, float)


def solution(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Matrix K (coalitions and, last, the full one x features) with
    attribution_j = sum over s of K[s, j] * (value_s - base)."""
    d = masks.shape[1]
    z = masks.astype(float)
    a = z[:, :-1] - z[:, -1:]
    g = np.linalg.pinv((a * weights[:, None]).T @ a) @ (a * weights[:, None]).T  # (d - 1) x coalitions
    k = np.zeros((len(masks) + 1, d))
    k[:-1, :-1] = g.T
    k[-1, :-1] = -g @ z[:, -1]
    k[:, -1] = -k[:, :-1].sum(axis=1)
    k[-1, -1] += 1.0
    return k


def kernel_attributions(model, rows: DataFrame, background: DataFrame, id_col: str, features: str, names: list[str],
                        n_coalitions: int = 50, n_background: int = 30, seed: int = 42,
                        output: str = "prediction") -> DataFrame:
    """(id, feature, value, class, attribution) of every row, feature and
    output.  ``output='probability'`` explains each class (class is its
    number), any other column one number (class is NULL).

    The background is ``n_background`` rows of ``background`` in the order of
    a hash of their id; ids of ``rows`` must be unique."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    spark, d = rows.sparkSession, len(names)
    masks, weights = coalitions(d, n_coalitions, seed)
    k = solution(masks, weights)
    masks = np.vstack([masks, np.ones(d, bool)])
    chosen = background.orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), id_col).limit(n_background)

    def outputs(df: DataFrame) -> DataFrame:
        """``df`` with a row for each output: (class, f)."""
        out = model.transform(df)
        value = vector_to_array("probability") if output == "probability" else F.array(F.col(output).cast("double"))
        return out.select(*[c for c in df.columns if c != features], F.posexplode(value).alias("class", "f"))

    points = chosen.select(vector_to_array(features).alias("b"))
    base = outputs(points.withColumn(features, array_to_vector("b"))).groupBy("class").agg(F.avg("f").alias("base"))
    # one row: the coalitions with their columns of K, and the background rows
    design = spark.createDataFrame([([(m.tolist(), c.tolist()) for m, c in zip(masks, k)],)],
                                   "coalitions array<struct<mask:array<boolean>,k:array<double>>>")
    design = design.crossJoin(points.agg(F.collect_list("b").alias("points")))
    each = (rows.select(F.col(id_col).alias("id"), vector_to_array(features).alias("x")).crossJoin(F.broadcast(design))
            .select("id", "x", F.size("points").alias("n"), "points", F.inline("coalitions"))
            .select("id", "x", "mask", "k", "n", F.explode("points").alias("b")))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                        lambda i: F.when(F.get("mask", i), F.get("x", i)).otherwise(F.get("b", i)))
    scored = outputs(each.select("id", "k", "n", array_to_vector(mixed).alias(features)))
    sums = scored.groupBy("id", "class").agg(*[F.sum(F.get("k", F.lit(j)) * F.col("f") / F.col("n")).alias(f"s{j}") for j in range(d)])
    whole = k.sum(axis=0).tolist()  # of K, for the base
    per = sums.join(F.broadcast(base), "class").select(  # base: one row per class
        "id", "class", F.inline(F.array(*[
            F.struct(F.lit(j).alias("j"), (F.col(f"s{j}") - F.col("base") * whole[j]).alias("attribution")) for j in range(d)])))
    label = F.array(*[F.lit(n) for n in names])
    values = rows.select(F.col(id_col).alias("id"), vector_to_array(features).alias("x"))
    cls = F.col("class") if output == "probability" else F.lit(None).cast("int")
    return per.join(values, "id").select(F.col("id").alias(id_col), F.get(label, F.col("j")).alias("feature"),
                                         F.get("x", F.col("j")).alias("value"), cls.alias("class"), "attribution")
