"""Scalar and aggregate expression helpers.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.  Missing means NULL *or* NaN (pandas treats
both as missing); ``num`` turns NaN into NULL on entry so averages behave like
pandas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "is_missing", "num", "safe_div", "skew_unbiased", "kurt_unbiased",
    "severity_band", "score_band", "field_type", "is_numeric_type",
    "wide_to_long", "rnd",
]


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType)


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns."""
    c = F.col(name)
    if isinstance(field_type(df, name), (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def num(df: DataFrame, name: str) -> Column:
    """Column as double with NaN mapped to NULL."""
    c = F.col(name).cast("double")
    if isinstance(field_type(df, name), (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None).cast("double"))
    return c


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode would raise)."""
    return F.try_divide(a, F.when(b != 0, b))


def skew_unbiased(n: Column, g1: Column) -> Column:
    """Population skewness → bias-corrected (pandas ``skew``)."""
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1)


def kurt_unbiased(n: Column, g2: Column) -> Column:
    """Population excess kurtosis → bias-corrected (pandas ``kurt``)."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def severity_band(pct: Column) -> Column:
    """Missing-value severity: > 50 % high, > 20 % medium, else low."""
    return F.when(pct > 50, "high").when(pct > 20, "medium").otherwise("low")


def score_band(score: Column) -> Column:
    """Verbal grade of a model score (> .9 / > .8 / > .7)."""
    return (F.when(score > 0.9, "excellent").when(score > 0.8, "very good")
            .when(score > 0.7, "good").otherwise("fair"))


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def wide_to_long(row_df: DataFrame, cols: list[str], fields: dict[str, str],
                 name_col: str = "column") -> DataFrame:
    """Turn a one-row (or few-row) wide aggregate into one row per column.

    ``fields`` maps output field → template containing ``{c}`` for the wide
    column of column ``c``; e.g. ``{"mean": "{c}__mean"}``.
    """
    structs = [
        F.struct(F.lit(c).alias(name_col),
                 *[F.col(f"`{tpl.format(c=c)}`").alias(out) for out, tpl in fields.items()])
        for c in cols
    ]
    return row_df.select(F.inline(F.array(*structs)))
