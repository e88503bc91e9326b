"""Gaussian kernel densities on a grid.

A density needs the sum over all values of exp(-u^2 / 2), u = (point - x) / h.
Values are put into bins of ``BIN`` bandwidths, and one aggregate takes, per
column and bin, the sums of v^j for j < ``TERMS`` with v = (x - bin's centre) /
h; then

    exp(-(u - v)^2 / 2) = sum over j of v^j / j! * He_j(u) * exp(-u^2 / 2)

(He_j: Hermite polynomials).  As |v| <= BIN / 2, the terms left out are below
(BIN / 2)^TERMS / sqrt(TERMS!) per value, 1e-16 of the kernel's peak with the
values below: the sums are exact to rounding, whatever the number of rows.
The rows are read by generated code with a combine before the shuffle; only
bins meet the grid.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.exprs import num


def _stats(df: DataFrame, x):
    return df.agg(F.count(x).alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi"),
                  F.stddev_samp(x).alias("__sd"))


BIN, TERMS = 0.5, 16  # bin width in bandwidths, terms of the series


def _kernel_sums(vals: DataFrame, grids: dict[str, tuple[float, float, float]], points: int) -> DataFrame:
    """(name, point, s): the kernel sums of the values (name, x) at lo + point
    * step; ``grids``: name -> (lo, step, bandwidth), one per column."""
    lo, h = (F.create_map(*[F.lit(v) for n, g in grids.items() for v in (n, float(g[i]))])[F.col("name")] for i in (0, 2))
    wide = vals.select("name", "x", lo.alias("lo"), h.alias("h")).withColumn(
        "bin", F.floor((F.col("x") - F.col("lo")) / (F.col("h") * BIN)))
    v = (F.col("x") - F.col("lo")) / F.col("h") - (F.col("bin") + 0.5) * BIN
    powers = [F.lit(1.0)]
    for _ in range(TERMS - 1):
        powers.append(powers[-1] * F.col("v"))
    bins = wide.select("name", "bin", v.alias("v")).groupBy("name", "bin").agg(
        F.array(*[F.sum(p) for p in powers]).alias("m"))

    def run(batches):
        acc = {n: np.zeros(points) for n in grids}
        factorial = np.cumprod(np.maximum(1, np.arange(TERMS, dtype="float64")))
        for b in batches:
            for n, part in b.groupby("name"):
                _, step, h = grids[n]
                centre = (part["bin"].to_numpy(dtype="float64") + 0.5) * BIN
                m = np.stack(part["m"].to_numpy()) / factorial
                for at in range(0, len(centre), 1024):
                    u = (np.arange(points) * (step / h))[None, :] - centre[at:at + 1024, None]
                    before, now = np.zeros_like(u), np.exp(-0.5 * u * u)
                    for j in range(TERMS):
                        acc[n] += (m[at:at + 1024, j, None] * now).sum(axis=0)
                        before, now = now, u * now - j * before
        yield pd.concat([pd.DataFrame({"name": n, "point": np.arange(points, dtype="int32"), "s": a}) for n, a in acc.items()])
    return bins.mapInPandas(run, "name string, point int, s double").groupBy("name", "point").agg(F.sum("s").alias("s"))


def kde(df: DataFrame, col: str, points: int = 100, bandwidth: float | None = None,
        digits: int | None = 8) -> DataFrame:
    """Density at ``points`` equally spaced points from min to max →
    (point, x, density).  Bandwidth defaults to Scott's rule:
    std (n-1) · n^(-1/5)."""
    x = num(df, col)
    st = _stats(df, x).first()  # one row
    n, lo, hi, sd = st["__n"], st["__lo"], st["__hi"], st["__sd"]
    spark = df.sparkSession
    schema = "point int, x double, density double"
    if not n or lo is None:
        return spark.createDataFrame([], schema)
    h = bandwidth or ((sd or 0.0) * n ** -0.2)
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    if not h or h <= 0:
        return spark.createDataFrame([(i, lo + i * step, None) for i in range(points)], schema)
    vals = df.select(F.lit(col).alias("name"), x.cast("double").alias("x")).where("x IS NOT NULL")
    norm = n * h * math.sqrt(2 * math.pi)
    density = F.col("s") / F.lit(norm)
    return _kernel_sums(vals, {col: (lo, step, h)}, points).select(
        "point", F.round(F.lit(lo) + F.col("point") * F.lit(step), 6).alias("x"),
        (density if digits is None else F.round(density, digits)).alias("density"))


def violin_density(df: DataFrame, cols: list[str], points: int = 100, digits: int = 8) -> DataFrame:
    """Per column KDE (Scott bandwidth) at ``points`` points → (column, point,
    x, density).  Two scans for all columns together: one aggregate for the
    grids, one for the bins.  Columns with < 3 values or one distinct value are
    skipped (no spread)."""
    names = [f"c{i}" for i in range(len(cols))]
    vals = df.select(*[num(df, c).alias(n) for c, n in zip(cols, names)])
    st = vals.agg(*[e.alias(f"{k}_{n}") for n in names for k, e in (
        ("n", F.count(n)), ("lo", F.min(n)), ("hi", F.max(n)), ("sd", F.stddev_samp(n)))]).first()
    grids = {}
    for c, n in zip(cols, names):
        count, lo, hi, sd = (st[f"{k}_{n}"] for k in ("n", "lo", "hi", "sd"))
        if count >= 3 and sd and sd > 0:
            grids[n] = (c, lo, (hi - lo) / (points - 1) if points > 1 else 0.0, sd * count ** -0.2, count)
    schema = "column string, point int, x double, density double"
    if not grids:
        return df.sparkSession.createDataFrame([], schema)

    long = vals.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in grids])))
    part = _kernel_sums(long.where("x IS NOT NULL"), {n: (lo, step, h) for n, (_, lo, step, h, _) in grids.items()}, points)
    table = df.sparkSession.createDataFrame(
        [(n, c, lo, step, count * h * math.sqrt(2 * math.pi)) for n, (c, lo, step, h, count) in grids.items()],
        "name string, column string, lo double, step double, norm double")
    return (part.join(F.broadcast(table), "name")  # one row per column
            .select("column", "point", F.round(F.col("lo") + F.col("point") * F.col("step"), 6).alias("x"),
                    F.round(F.col("s") / F.col("norm"), digits).alias("density")))


def scaled_density(df: DataFrame, col: str, points: int = 300, bins: int = 35,
                   digits: int = 8) -> DataFrame:
    """KDE scaled so its peak equals the tallest histogram bin (``bins``
    equal-width bins) → (point, x, density, scaled)."""
    from tabsight.operators.profile import histogram
    k = kde(df, col, points, digits=None)
    tallest = histogram(df, col, bins).agg(F.max("count").alias("__top"))
    peak = k.agg(F.max("density").alias("__peak"))
    return (k.crossJoin(F.broadcast(tallest)).crossJoin(F.broadcast(peak))
            .select("point", "x", F.round("density", digits).alias("density"),
                    F.round(F.col("density") * F.col("__top") / F.col("__peak"), 4).alias("scaled")))
