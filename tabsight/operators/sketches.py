"""Mergeable column profiles (G4, G5, G22): statistics of a table that are kept
per part of it and merged, so that new data does not make the old be read
again.

A row of a sketch table describes one column of one part (a day, a load): row
and missing counts, extremes, mean and variance, a HyperLogLog sketch of its
distinct values and, for numbers, a KLL sketch of their distribution.  The
sketches are Spark's own aggregates; a part is one scan, and merging reads the
sketch table only.  ``write_results``/``read_table`` keep it as Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.functions.exprs import is_missing, is_numeric_type, num

HLL_BITS = 12  # relative standard error 1.04 / 2^(bits / 2): 1.6 %
KLL_SIZE = 400  # rank error about 2.3 / size^0.9: 0.7 % (99 % of the time)


def sketch_table(df: DataFrame, cols: list[str] | None = None, part: list[str] | None = None, hll_bits: int = HLL_BITS,
                 kll_size: int = KLL_SIZE) -> DataFrame:
    """(part…, column, n_rows, n_missing, lo, hi, mean, var, hll, kll), one
    scan.  Missing is NULL or NaN; lo … var and kll are NULL for columns that
    are no numbers, hll for columns without a value."""
    part = list(part or [])
    cols = cols or [c for c in df.columns if c not in part]
    aggs, structs = [F.count(F.lit(1)).alias("__n")], []
    for i, c in enumerate(cols):
        missing = is_missing(df, c)
        number = is_numeric_type(df.schema[c].dataType)
        value = F.when(~missing, F.col(f"`{c}`").cast("string"))
        x = num(df, c).cast("double") if number else F.lit(None).cast("double")
        fields: dict[str, Column] = {
            "n_missing": F.sum(missing.cast("long")), "lo": F.min(x), "hi": F.max(x), "mean": F.avg(x), "var": F.var_pop(x),
            "hll": F.hll_sketch_agg(value, F.lit(hll_bits)),
            "kll": F.kll_sketch_agg_double(x, F.lit(kll_size)) if number else F.first(F.lit(None).cast("binary"))}
        aggs += [e.alias(f"{k}_{i}") for k, e in fields.items()]
        structs.append(F.struct(F.lit(c).alias("column"), F.col("__n").alias("n_rows"), *[F.col(f"{k}_{i}").alias(k) for k in fields]))
    wide = df.groupBy(*part).agg(*aggs)
    return wide.select(*part, F.inline(F.array(*structs)))


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketch table of the union of parts, per ``by`` (default: all)."""
    keys = [*(by or []), "column"]
    values = F.col("n_rows") - F.col("n_missing")
    means = sketches.where("mean IS NOT NULL").groupBy(*keys).agg((F.sum(values * F.col("mean")) / F.sum(values)).alias("__mean"))
    apart = F.col("mean") - F.col("__mean")
    return sketches.join(means, keys, "left").groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.first("__mean").alias("mean"),
        (F.sum(F.when(values > 0, values * (F.col("var") + apart * apart))) / F.sum(F.when(F.col("var").isNotNull(), values))).alias("var"),
        F.hll_union_agg("hll", F.lit(True)).alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))


def profile_of(sketches: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75), by: list[str] | None = None) -> DataFrame:
    """(by…, column, n_rows, n_missing, n_distinct, mean, std, lo, quantiles,
    hi) of a sketch table with one row per column (and ``by``); n_distinct and
    the quantiles are estimates, std is that of a sample."""
    values = F.col("n_rows") - F.col("n_missing")
    filled = F.col("kll").isNotNull() & F.col("mean").isNotNull()  # a merge of no sketches is an empty one
    quantiles = F.when(filled, F.array(*[F.kll_sketch_get_quantile_double(F.when(filled, F.col("kll")), F.lit(float(p))) for p in probs]))
    return sketches.select(
        *(by or []), "column", "n_rows", "n_missing", F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0)).alias("n_distinct"),
        "mean", F.when(values > 1, F.sqrt(F.col("var") * values / (values - 1))).alias("std"), "lo", quantiles.alias("quantiles"), "hi")


def measured_errors(df: DataFrame, profile: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, distinct_error, rank_error) of a profile of ``df`` against the
    rows: relative error of the distinct count, and by how much the share of
    values up to a quantile (or below it, for ties) misses its probability."""
    rows = profile.select("column", "n_distinct", "quantiles").collect()  # one per column
    aggs = []
    for i, r in enumerate(rows):
        c = r["column"]
        x = num(df, c) if is_numeric_type(df.schema[c].dataType) else F.col(f"`{c}`")
        aggs.append(F.count_distinct(x).alias(f"d{i}"))
        for j, q in enumerate(r["quantiles"] or []):
            up_to, below = (F.avg(F.when(x.isNotNull(), cond.cast("double"))) for cond in (x <= F.lit(q), x < F.lit(q)))
            aggs.append(F.greatest(F.lit(0.0), F.lit(probs[j]) - up_to, below - F.lit(probs[j])).alias(f"e{i}_{j}"))
    got = df.agg(*aggs)
    structs = []
    for i, r in enumerate(rows):
        n = F.col(f"d{i}")
        worst = [F.col(f"e{i}_{j}") for j in range(len(r["quantiles"] or []))]
        rank = F.greatest(*worst) if len(worst) > 1 else (worst[0] if worst else F.lit(None).cast("double"))
        structs.append(F.struct(F.lit(r["column"]).alias("column"),
                                F.when(n > 0, F.abs(F.lit(r["n_distinct"]) - n) / n).otherwise(0.0).alias("distinct_error"),
                                rank.alias("rank_error")))
    return got.select(F.inline(F.array(*structs)))
