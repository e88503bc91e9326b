"""Schema inspection and column predicates.

Schema-only helpers (``numeric_columns`` …) read ``df.schema`` and run no job.
Data-dependent predicates fold every column into ONE aggregate so a wide table
costs one scan, not one job per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.exprs import is_missing, is_numeric_type, num
from tabsight.functions.text import DATE_NAME_TOKENS, token_count


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set([exclude] if isinstance(exclude, str) else exclude or ())
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in ex]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    ex = set([exclude] if isinstance(exclude, str) else exclude or ())
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not is_numeric_type(f.dataType) and not isinstance(f.dataType, T.StringType)]


def date_candidates(df: DataFrame) -> list[str]:
    """Typed timestamp/date columns first, then columns whose lower-cased name
    contains a date word."""
    typed = [f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    named = [f.name for f in df.schema.fields
             if any(t in f.name.lower() for t in DATE_NAME_TOKENS) and f.name not in typed]
    return typed + named


def public_columns(df: DataFrame) -> DataFrame:
    return df.select([f"`{c}`" for c in df.columns if not c.startswith("_")])


def drop_column(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*[c for c in cols if c and c in df.columns])


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    cond = None
    for c in subset:
        e = ~is_missing(df, c)
        cond = e if cond is None else cond & e
    return df if cond is None else df.where(cond)


def fill_missing(df: DataFrame, numeric_value=0.0, string_value: str = "") -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.coalesce(F.nanvl(c, F.lit(None).cast(f.dataType)), F.lit(numeric_value).cast(f.dataType))
        elif is_numeric_type(f.dataType):
            c = F.coalesce(c, F.lit(numeric_value).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(string_value))
        out.append(c.alias(f.name))
    return df.select(out)


def to_string_key(df: DataFrame, col: str):
    """Value as text; missing becomes the literal ``nan`` (as pandas ``astype(str)``)."""
    c = F.col(col).cast("string")
    return F.when(is_missing(df, col), F.lit("nan")).otherwise(c)


def exclude_values(df: DataFrame, col: str, values) -> DataFrame:
    return df.where(~F.col(col).isin(list(values)))


def text_columns(df: DataFrame, target: str | None = None, min_tokens: float = 5) -> DataFrame:
    """String columns whose mean whitespace-token count over non-null rows
    exceeds ``min_tokens`` → (column, mean_tokens, is_text)."""
    cols = categorical_columns(df, exclude=[target] if target else [])
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, mean_tokens double, is_text boolean")
    row = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), token_count(F.col(c)))).alias(c) for c in cols])
    long = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("mean_tokens")) for c in cols])))
    return long.withColumn("is_text", F.coalesce(F.col("mean_tokens") > min_tokens, F.lit(False)))


def missing_shares(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    row = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_share")) for c in cols])))


def drop_sparse_columns(df: DataFrame, target: str | None = None,
                        max_missing: float = 0.5) -> DataFrame:
    """Drop every column (except the target) with missing share > ``max_missing``.
    One aggregate decides; the result is the same lazy plan minus those columns."""
    shares = missing_shares(df).collect()  # one row per column: schema-sized
    drop = [r["column"] for r in shares
            if r["missing_share"] is not None and r["missing_share"] > max_missing and r["column"] != target]
    return df.drop(*drop)


def infer_problem(df: DataFrame, target: str | None, max_classes: int = 20,
                  exact: bool = True) -> DataFrame:
    """(target, dtype, n_distinct, problem): none → clustering; string or
    ≤ ``max_classes`` distinct → classification; else regression."""
    spark = df.sparkSession
    if not target:
        return spark.createDataFrame([(None, None, None, "clustering")],
                                     "target string, dtype string, n_distinct bigint, problem string")
    dt = df.schema[target].dataType
    c = num(df, target) if is_numeric_type(dt) else F.col(target)
    nd = F.countDistinct(c) if exact else F.approx_count_distinct(c)
    is_string = isinstance(dt, T.StringType)
    return df.agg(nd.cast("bigint").alias("n_distinct")).select(
        F.lit(target).alias("target"), F.lit(dt.simpleString()).alias("dtype"), "n_distinct",
        F.when(F.lit(is_string) | (F.col("n_distinct") <= max_classes), "classification")
        .otherwise("regression").alias("problem"))


def distinct_counts(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """(column, n_distinct).  Exact counts are one small aggregate for each
    column over that column alone (several distinct counts in one aggregate
    would copy every row once per column); ``exact=False`` is one
    HyperLogLog++ aggregate."""
    x = {c: num(df, c) if is_numeric_type(df.schema[c].dataType) else F.col(f"`{c}`") for c in cols}
    if not exact:
        row = df.agg(*[F.approx_count_distinct(x[c]).cast("bigint").alias(f"d{i}") for i, c in enumerate(cols)])
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(cols)])))
    parts = [df.select(x[c].alias("v")).where("v IS NOT NULL").distinct()
             .agg(F.lit(c).alias("column"), F.count(F.lit(1)).cast("bigint").alias("n_distinct")) for c in cols]
    return reduce(DataFrame.unionAll, parts)


def short_categoricals(df: DataFrame, target: str | None = None, text_cols=(),
                       max_card: int = 15, k: int = 4, exact: bool = True) -> DataFrame:
    """First ``k`` string columns (schema order) with ≤ ``max_card`` distinct
    values, skipping the target and text columns → (position, column, n_distinct)."""
    cols = [c for c in categorical_columns(df, exclude=[target] if target else [])
            if c not in set(text_cols)]
    if not cols:
        return df.sparkSession.createDataFrame([], "position int, column string, n_distinct bigint")
    counts = distinct_counts(df, cols, exact)
    pos = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "position int, column string")
    from pyspark.sql import Window
    w = Window.orderBy("position")  # ≤ number of string columns: schema-sized
    return (counts.join(F.broadcast(pos), "column")
            .where(F.col("n_distinct") <= max_card)
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k).drop("rank")
            .select("position", "column", "n_distinct"))


def positive_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns where every value is > 0 and none is missing (one aggregate)."""
    if not cols:
        return []
    row = df.agg(*[(F.min(num(df, c)) > 0).alias(f"p{i}") for i, c in enumerate(cols)],
                 *[F.sum(is_missing(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"p{i}"] and not row[f"m{i}"]]
