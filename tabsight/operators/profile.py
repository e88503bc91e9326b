"""Profiling aggregates.

Rule for every function here: all per-column statistics of a table are folded
into ONE ``agg`` (one scan, partial aggregation map-side, one tiny final
merge), then reshaped to one row per column with ``inline``.  Statistics that
rows are compared against travel as a one-row DataFrame joined with
``crossJoin(broadcast(...))`` — a size bound of exactly one row — never as an
empty ``Window.partitionBy()``, which would pull the whole table into one task.

Quantiles default to the exact, linearly interpolated definition (pandas
``quantile``), computed in bounded memory at any size.  ``exact=False``
switches to the sketch ``percentile_approx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.functions.exprs import is_missing, is_numeric_type, num, severity_band
from tabsight.operators.columns import categorical_columns, distinct_counts, numeric_columns, other_columns
from tabsight.operators.quantiles import exact_quantiles

QUANTILE_ACCURACY = 100_000


def quantile_expr(x, probs, exact: bool = True):
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if exact:
        return F.percentile(x, arr)
    return F.percentile_approx(x, arr, QUANTILE_ACCURACY).cast("array<double>")


def quantile_row(df: DataFrame, exprs: dict, probs, exact: bool | str = True) -> DataFrame:
    """One-row table ``{name}__q{i}`` of quantiles of named numeric columns.
    ``exact``: True → bounded exact quantiles (``operators/quantiles.py``),
    ``'percentile'`` → Spark's ``percentile`` (one pass, but the whole
    value→count map in one task), False → ``percentile_approx``."""
    if exact is True:
        got = exact_quantiles(df, exprs, probs)
        row = tuple(got[(n, float(p))] for n in exprs for p in probs)
        schema = ", ".join(f"`{n}__q{i}` double" for n in exprs for i in range(len(probs)))
        return df.sparkSession.createDataFrame([row], schema)
    agg = df.agg(*[quantile_expr(x, probs, bool(exact)).alias(f"{n}__qa") for n, x in exprs.items()])
    return agg.select(*[F.col(f"`{n}__qa`")[i].alias(f"{n}__q{i}") for n in exprs for i in range(len(probs))])


def column_stats(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75),
                 exact: bool | str = True) -> DataFrame:
    """One-row wide table: ``{c}__n, __mean, __std, __std_pop, __min, __max,
    __q0 …`` for every column (NaN counted as missing)."""
    aggs = []
    for c in cols:
        x = num(df, c)
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.stddev_pop(x).alias(f"{c}__std_pop"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    row = df.agg(*aggs)
    if not probs:
        return row
    return row.crossJoin(F.broadcast(quantile_row(df, {c: num(df, c) for c in cols}, probs, exact)))


def dataset_summary(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells, numeric / categorical / other column counts."""
    miss = [F.sum(is_missing(df, c).cast("long")) for c in df.columns]
    total_missing = miss[0] if miss else F.lit(0)
    for m in miss[1:]:
        total_missing = total_missing + m
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.coalesce(total_missing, F.lit(0)).cast("bigint").alias("n_missing"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("n_numeric"),
        F.lit(len(categorical_columns(df))).cast("bigint").alias("n_categorical"),
        F.lit(len(other_columns(df))).cast("bigint").alias("n_other"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """(kind, n_columns) for Numeric / Categorical / Other, zero kinds removed."""
    rows = [("Numeric", len(numeric_columns(df))), ("Categorical", len(categorical_columns(df))),
            ("Other", len(other_columns(df)))]
    return df.sparkSession.createDataFrame([r for r in rows if r[1] > 0], "kind string, n_columns bigint")


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with any missing value → (column, n_missing, pct_missing, severity)."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("__rows"), *[F.sum(is_missing(df, c).cast("long")).alias(f"m{i}")
                                     for i, c in enumerate(df.columns)])
    long = row.select("__rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"))
        for i, c in enumerate(df.columns)])))
    pct = F.round(F.col("n_missing") * 100.0 / F.col("__rows"), 4)
    return (long.where(F.col("n_missing") > 0)
            .select("column", F.col("n_missing").cast("bigint").alias("n_missing"),
                    pct.alias("pct_missing"))
            .withColumn("severity", severity_band(F.col("pct_missing"))))


def describe_numeric(df: DataFrame, cols: list[str] | None = None, digits: int = 2,
                     exact: bool = True) -> DataFrame:
    """pandas ``describe().round(2)`` as one row per column: count, mean,
    std (n-1), min, 25 %, 50 %, 75 %, max."""
    cols = cols or numeric_columns(df)
    row = column_stats(df, cols, (0.25, 0.5, 0.75), exact)
    fields = {"count": "{c}__n", "mean": "{c}__mean", "std": "{c}__std", "min": "{c}__min",
              "p25": "{c}__q0", "p50": "{c}__q1", "p75": "{c}__q2", "max": "{c}__max"}
    long = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 *[F.col(f"`{t.format(c=c)}`").cast("double").alias(k) for k, t in fields.items()])
        for c in cols])))
    return long.select("column", F.col("count").cast("bigint").alias("count"),
                       *[F.round(k, digits).alias(k) for k in list(fields)[1:]])


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, dtype, non_null, n_null, n_distinct, null_pct) for every column.
    Missing counts are one aggregate; distinct counts are exact and made for
    each column over that column alone (``exact=False``: HyperLogLog++)."""
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[
        F.sum(is_missing(df, f.name).cast("long")).alias(f"m{i}") for i, f in enumerate(fields)])
    long = row.select("__rows", F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"m{i}").alias("n_null"))
        for i, f in enumerate(fields)])))
    counts = distinct_counts(df, df.columns, exact)
    return long.join(F.broadcast(counts), "column").orderBy("position").select(
        "column", "dtype", (F.col("__rows") - F.col("n_null")).cast("bigint").alias("non_null"),
        F.col("n_null").cast("bigint").alias("n_null"), F.col("n_distinct").cast("bigint").alias("n_distinct"),
        F.round(F.col("n_null") * 100.0 / F.col("__rows"), 1).alias("null_pct"))


def value_counts(df: DataFrame, col: str, top: int | None = None, digits: int = 6) -> DataFrame:
    """Count per value (missing excluded) and share of all non-missing rows.
    The total is the sum over the grouped result; Spark reuses the grouped
    exchange for it, so the table is scanned once."""
    x = num(df, col) if is_numeric_type(df.schema[col].dataType) else F.col(col)
    g = df.select(x.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    tot = g.agg(F.sum("count").alias("__total"))
    out = g.crossJoin(F.broadcast(tot)).select(
        "value", "count", F.round(F.col("count") / F.col("__total"), digits).alias("share"))
    if top:
        out = out.orderBy(F.desc("count"), "value").limit(top)
    return out


def category_counts(df: DataFrame, cols: list[str], top: int = 12, digits: int = 4) -> DataFrame:
    """Per column the ``top`` most frequent values with % of ALL rows
    → (column, rank, value, count, pct).  One scan and one partial
    aggregation over (column, value) for all columns; the rank keeps ``top``
    rows per column and task before its shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    total = df.agg(F.count(F.lit(1)).alias("__rows"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    counted = (df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value")
               .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
               .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))
    return counted.crossJoin(F.broadcast(total)).select(
        "column", "rank", "value", "count",
        F.round(F.col("count") * 100.0 / F.col("__rows"), digits).alias("pct"))


def histogram(df: DataFrame, col: str, bins: int = 40, digits: int = 6) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed (NumPy's rule); empty
    bins are present with count 0 → (bin, lo, hi, count)."""
    x = num(df, col)
    stats = df.agg(F.min(x).alias("__lo0"), F.max(x).alias("__hi0")).select(
        F.when(F.col("__hi0") > F.col("__lo0"), F.col("__lo0")).otherwise(F.col("__lo0") - 0.5).alias("__lo"),
        F.when(F.col("__hi0") > F.col("__lo0"), F.col("__hi0")).otherwise(F.col("__hi0") + 0.5).alias("__hi"))
    b = F.least(F.floor((F.col("__x") - F.col("__lo")) * bins / (F.col("__hi") - F.col("__lo"))),
                F.lit(bins - 1)).cast("int")
    counts = (df.select(x.alias("__x")).where(F.col("__x").isNotNull())
              .crossJoin(F.broadcast(stats))
              .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    grid = (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
            .crossJoin(F.broadcast(stats)))
    width = (F.col("__hi") - F.col("__lo")) / bins
    return (grid.join(counts, "bin", "left")
            .select("bin", F.round(F.col("__lo") + F.col("bin") * width, digits).alias("lo"),
                    F.round(F.col("__lo") + (F.col("bin") + 1) * width, digits).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def center_markers(df: DataFrame, col: str, digits: int = 6, exact: bool | str = True) -> DataFrame:
    x = num(df, col)
    med = quantile_row(df, {"m": x}, [0.5], exact)
    return df.agg(F.round(F.avg(x), digits).alias("mean")).crossJoin(med).select(
        "mean", F.round("m__q0", digits).alias("median"))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Pearson correlation, pairwise-complete, lower triangle without the
    diagonal → (col_a, col_b, corr).  NULL when either side is constant.

    Pass 1 (one aggregate): column means, spread flags and missing counts.
    Pass 2: sums of centred products.  When no column has a missing value the
    pairwise-complete rows are all rows, so the per-column sums are shared and
    pass 2 needs d + d(d−1)/2 sums instead of 6 per pair (which also keeps the
    aggregate under the code-generation field limit).
    """
    cols = cols or numeric_columns(df)
    pairs = [(a, cols[j]) for i, a in enumerate(cols) for j in range(i)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    idx = {c: i for i, c in enumerate(cols)}
    means = df.agg(*[F.avg(num(df, c)).alias(f"__m{i}") for i, c in enumerate(cols)],
                   *[(F.max(num(df, c)) > F.min(num(df, c))).alias(f"__v{i}") for i, c in enumerate(cols)],
                   *[F.count(F.when(num(df, c).isNull(), 1)).alias(f"__z{i}") for i, c in enumerate(cols)])
    first = means.first()  # one row
    complete = all(first[f"__z{i}"] == 0 for i in range(len(cols)))
    lit_means = {c: F.lit(first[f"__m{idx[c]}"]).cast("double") for c in cols}
    xs = {c: num(df, c) - lit_means[c] for c in cols}
    if complete:
        aggs = [F.count(F.lit(1)).alias("n")]
        aggs += [F.sum(xs[c]).alias(f"s{idx[c]}") for c in cols]
        aggs += [F.sum(xs[c] * xs[c]).alias(f"q{idx[c]}") for c in cols]
        aggs += [F.sum(xs[a] * xs[b]).alias(f"sab{k}") for k, (a, b) in enumerate(pairs)]
        row = df.agg(*aggs)

        def parts(k):
            a, b = pairs[k]
            ia, ib = idx[a], idx[b]
            return (F.col("n"), F.col(f"s{ia}"), F.col(f"s{ib}"), F.col(f"sab{k}"), F.col(f"q{ia}"), F.col(f"q{ib}"))
    else:
        aggs = []
        for k, (a, b) in enumerate(pairs):
            both = xs[a].isNotNull() & xs[b].isNotNull()
            xa, xb = F.when(both, xs[a]), F.when(both, xs[b])
            aggs += [F.count(xa).alias(f"n{k}"), F.sum(xa).alias(f"sa{k}"), F.sum(xb).alias(f"sb{k}"),
                     F.sum(xa * xb).alias(f"sab{k}"), F.sum(xa * xa).alias(f"saa{k}"), F.sum(xb * xb).alias(f"sbb{k}")]
        row = df.agg(*aggs)

        def parts(k):
            return tuple(F.col(f"{p}{k}") for p in ("n", "sa", "sb", "sab", "saa", "sbb"))

    def r(k):
        n, sa, sb, sab, saa, sbb = parts(k)
        cov = sab - sa * sb / n
        va = saa - sa * sa / n
        vb = sbb - sb * sb / n
        a, b = pairs[k]
        varies = F.lit(bool(first[f"__v{idx[a]}"]) and bool(first[f"__v{idx[b]}"]))
        return F.when(varies & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))

    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.round(r(k), digits).alias("corr"))
        for k, (a, b) in enumerate(pairs)])))


def box_stats(df: DataFrame, cols: list[str], k: float = 1.5, digits: int = 6,
              exact: bool = True) -> DataFrame:
    """Box-plot table per column: quartiles, fences, whiskers (furthest values
    inside the fences), mean, std (n-1), number of fliers."""
    st = column_stats(df, cols, (0.25, 0.5, 0.75), exact)
    aggs = []
    for i, c in enumerate(cols):
        x = num(df, c)
        q1, q3 = F.col(f"{c}__q0"), F.col(f"{c}__q2")
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        aggs += [F.min(F.when(x >= lo, x)).alias(f"{c}__wlo"), F.max(F.when(x <= hi, x)).alias(f"{c}__whi"),
                 F.count(F.when((x < lo) | (x > hi), 1)).alias(f"{c}__fl")]
    second = df.crossJoin(F.broadcast(st)).agg(*aggs)
    row = st.crossJoin(second)
    out = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.col(f"{c}__q0").alias("q1"), F.col(f"{c}__q1").alias("median"), F.col(f"{c}__q2").alias("q3"),
                 (F.col(f"{c}__q0") - k * (F.col(f"{c}__q2") - F.col(f"{c}__q0"))).alias("lower_fence"),
                 (F.col(f"{c}__q2") + k * (F.col(f"{c}__q2") - F.col(f"{c}__q0"))).alias("upper_fence"),
                 F.col(f"{c}__wlo").alias("whisker_lo"), F.col(f"{c}__whi").alias("whisker_hi"),
                 F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                 F.col(f"{c}__fl").cast("bigint").alias("n_fliers"))
        for c in cols])))
    dbl = ["q1", "median", "q3", "lower_fence", "upper_fence", "whisker_lo", "whisker_hi", "mean", "std"]
    return out.select("column", *[F.round(F.col(d).cast("double"), digits).alias(d) for d in dbl], "n_fliers")


def median_all(df: DataFrame, cols: list[str], exact: bool | str = True) -> DataFrame:
    """One-row table of column medians (the fill values of median imputation)."""
    q = quantile_row(df, {c: num(df, c) for c in cols}, [0.5], exact)
    return q.select(*[F.col(f"`{c}__q0`").alias(c) for c in cols])
