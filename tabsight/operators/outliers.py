"""Outlier counting and removal.

Two scans in all: one aggregate for the column statistics (mean, population
std, quartiles), broadcast as a one-row table, and one aggregate that counts
rows beyond the limits for every column at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.exprs import num
from tabsight.operators.profile import column_stats, quantile_row


def _limit_counts(df: DataFrame, cols: list[str], z: float, k: float, exact: bool) -> DataFrame:
    st = column_stats(df, cols, (0.25, 0.75), exact)
    aggs = []
    for c in cols:
        x = num(df, c)
        mean, sd = F.col(f"{c}__mean"), F.col(f"{c}__std_pop")
        q1, q3 = F.col(f"{c}__q0"), F.col(f"{c}__q1")
        zhit = (sd > 0) & (F.abs(x - mean) / sd > z)
        ihit = (x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1))
        aggs += [F.count(F.when(zhit, 1)).alias(f"{c}__z"), F.count(F.when(ihit, 1)).alias(f"{c}__i")]
    row = df.crossJoin(F.broadcast(st)).agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__z").cast("bigint").alias("z_outliers"),
                 F.col(f"{c}__i").cast("bigint").alias("iqr_outliers")) for c in cols])))


def zscore_outliers(df: DataFrame, cols: list[str], z: float = 3.0, exact: bool = True) -> DataFrame:
    """(column, n_outliers): rows with |x-mean|/std_pop > z; zero rows dropped."""
    return (_limit_counts(df, cols, z, 1.5, exact)
            .select("column", F.col("z_outliers").alias("n_outliers")).where("n_outliers > 0"))


def iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5, exact: bool = True) -> DataFrame:
    """(column, n_outliers): rows strictly outside [Q1-k·IQR, Q3+k·IQR]."""
    return (_limit_counts(df, cols, 3.0, k, exact)
            .select("column", F.col("iqr_outliers").alias("n_outliers")).where("n_outliers > 0"))


def outlier_comparison(df: DataFrame, cols: list[str], z: float = 3.0, k: float = 1.5,
                       exact: bool = True) -> DataFrame:
    """Both counts side by side for columns flagged by either rule (the full
    outer join of the two count maps, absent → 0), ordered by column name."""
    return (_limit_counts(df, cols, z, k, exact)
            .where((F.col("z_outliers") > 0) | (F.col("iqr_outliers") > 0))
            .orderBy("column"))


def remove_z_outliers(df: DataFrame, cols: list[str], z: float = 3.0,
                      mode: str = "single_pass", exact: bool = True) -> DataFrame:
    """Keep rows whose z-score is ≤ ``z`` in every column.

    The z-score of a column is taken after filling its missing values with its
    median (so a missing value never removes a row by itself).  Constant
    columns are skipped (z undefined).

    * ``single_pass`` (default): statistics of the input for all columns at
      once — two small aggregates, one filter.
    * ``sequential``: column by column on the frame already filtered by the
      previous columns (result depends on column order).
    """
    if mode == "sequential":
        out = df
        for c in cols:
            out = _z_filter(out, [c], z, exact)
        return out
    return _z_filter(df, cols, z, exact)


def _z_filter(df: DataFrame, cols: list[str], z: float, exact: bool) -> DataFrame:
    q = quantile_row(df, {f"__m{i}": num(df, c) for i, c in enumerate(cols)}, [0.5], exact)
    med = q.select(*[F.col(f"__m{i}__q0").alias(f"__med{i}") for i in range(len(cols))])
    filled = {c: F.coalesce(num(df, c), F.col(f"__med{i}")) for i, c in enumerate(cols)}
    mom = df.crossJoin(F.broadcast(med)).agg(
        *[F.avg(filled[c]).alias(f"__mu{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(filled[c]).alias(f"__sd{i}") for i, c in enumerate(cols)])
    st = med.crossJoin(mom)
    keep = F.lit(True)
    for i, c in enumerate(cols):
        sd = F.col(f"__sd{i}")
        ok = (sd.isNull()) | (sd == 0) | (F.abs(filled[c] - F.col(f"__mu{i}")) / sd <= z)
        keep = keep & ok
    stat_cols = [f"__{p}{i}" for i in range(len(cols)) for p in ("med", "mu", "sd")]
    return df.crossJoin(F.broadcast(st)).where(keep).drop(*stat_cols)
