"""Time-series operators.

Series are keyed (``keys``, possibly empty for one series) and ordered by
``ts`` then ``id_col`` (a unique tiebreak).  Row-based frames use the
range-partitioned ranking of ``tabsight.operators.ordered`` so that a dominant key is
spread over many tasks; results equal an ordinary ordered window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.functions.exprs import num
from tabsight.operators.ordered import BLOCK, HOME, RANK, ordered_rank, with_blocks


def rolling_width(n: int) -> int:
    """Default window (fixed values 2, 30, 8): max(2, min(30, n // 8))."""
    return max(2, min(30, n // 8))


def parse_date(df: DataFrame, col: str, out: str | None = None, fmt: str | None = None) -> DataFrame:
    """Parse text to timestamp with coercion: unparseable → NULL."""
    c = F.col(col).cast("string")
    parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return df.withColumn(out or col, parsed)


def sort_by_time(df: DataFrame, ts: str, id_col: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).orderBy(ts, id_col)


def rolling_stats(df: DataFrame, keys: list[str], ts: str, val: str, w: int, id_col: str,
                  block_rows: int = 1_000_000, partitions: int | None = None, digits: int | None = 6) -> DataFrame:
    """Rolling mean and sample std over the last ``w`` rows and the ±1 std
    band; NULL until the frame holds ``w`` non-missing values (pandas
    ``rolling(w)``).  Adds ma, std, band_lo, band_hi."""
    x = num(df, val)
    base = df.withColumn("__v", x)
    ranked = ordered_rank(base, keys, ts, [id_col], partitions, with_count=False)
    blk = with_blocks(ranked, w - 1, block_rows)
    frame = Window.partitionBy(*keys, BLOCK).orderBy(RANK).rowsBetween(-(w - 1), 0)
    full = F.count("__v").over(frame) == w
    ma = F.when(full, F.avg("__v").over(frame))
    sd = F.when(full, F.stddev_samp("__v").over(frame))
    out = (blk.select("*", ma.alias("ma"), sd.alias("std")).where(F.col(HOME))
           .drop(BLOCK, HOME, RANK, "__v"))
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return out.select(*[c for c in df.columns], r(F.col("ma")).alias("ma"), r(F.col("std")).alias("std"),
                      r(F.col("ma") - F.col("std")).alias("band_lo"), r(F.col("ma") + F.col("std")).alias("band_hi"))


def add_lags(df: DataFrame, keys: list[str], ts: str, val: str, n: int, id_col: str,
             diff: bool = True, block_rows: int = 1_000_000, partitions: int | None = None,
             ts_is_rank: bool = False) -> DataFrame:
    """Add ``lag_1 … lag_n`` (previous values in time order) and, if asked,
    ``diff_1`` = value − previous value (the d = 1 of ARIMA).
    ``ts_is_rank``: ``ts`` already holds consecutive row numbers per key
    (skips the ranking)."""
    if ts_is_rank:
        ranked = df.withColumn(RANK, F.col(ts).cast("long"))
    else:
        ranked = ordered_rank(df, keys, ts, [id_col], partitions, with_count=False)
    blk = with_blocks(ranked, n, block_rows)
    w = Window.partitionBy(*keys, BLOCK).orderBy(RANK)
    lags = [F.lag(F.col(val), i).over(w).alias(f"lag_{i}") for i in range(1, n + 1)]
    out = blk.select("*", *lags).where(F.col(HOME)).drop(BLOCK, HOME, RANK)
    if diff:
        out = out.withColumn("diff_1", F.col(val) - F.col("lag_1"))
    return out


def time_split(df: DataFrame, keys: list[str], ts: str, id_col: str, frac: float = 0.8,
               partitions: int | None = None) -> DataFrame:
    """Per series, the first int(frac · n) rows in time order are train →
    adds ``split`` ('train' / 'test') and ``step`` (1-based position inside
    its part)."""
    ranked = ordered_rank(df, keys, ts, [id_col], partitions, with_count=True)
    cut = F.floor(F.col("__n") * F.lit(frac))
    return (ranked.withColumn("split", F.when(F.col(RANK) <= cut, "train").otherwise("test"))
            .withColumn("step", F.when(F.col(RANK) <= cut, F.col(RANK)).otherwise(F.col(RANK) - cut).cast("long"))
            .drop(RANK, "__n"))


def peak_and_low(df: DataFrame, keys: list[str], ts: str, val: str, id_col: str) -> DataFrame:
    """Per series: largest and smallest value and the time of its first
    occurrence (earliest time, then id) — one grouped aggregate."""
    x = num(df, val)
    d = df.select(*keys, F.col(ts).alias("__t"), F.col(id_col).alias("__id"), x.alias("__v")).where(
        F.col("__v").isNotNull() & F.col("__t").isNotNull())
    return d.groupBy(*keys).agg(
        F.max("__v").alias("peak_value"),
        F.min_by("__t", F.struct(-F.col("__v"), F.col("__t"), F.col("__id"))).alias("peak_ts"),
        F.min("__v").alias("low_value"),
        F.min_by("__t", F.struct(F.col("__v"), F.col("__t"), F.col("__id"))).alias("low_ts"))


def resample_mean(df: DataFrame, keys: list[str], ts: str, val: str, unit: str = "hour") -> DataFrame:
    """Regular series: mean value per (key, truncated time)."""
    return (df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).alias(ts))
            .agg(F.avg(num(df, val)).alias(val), F.count(F.lit(1)).cast("bigint").alias("n_obs")))


def rolling_by_key(df: DataFrame, keys: list[str], ts: str, val: str, id_col: str, digits: int | None = 6) -> DataFrame:
    """As ``rolling_stats`` with a width per key, from the key's own length
    (``rolling_width``, at most 30 rows); adds the width as ``w``."""
    widest = rolling_width(1 << 30)
    ranked = ordered_rank(df.withColumn("__v", num(df, val)), keys, ts, [id_col])
    own = F.greatest(F.lit(2), F.least(F.lit(widest), F.floor(F.col("__n") / 8))).cast("int")
    blk = with_blocks(ranked.withColumn("w", own), widest - 1)
    frame = Window.partitionBy(*keys, BLOCK).orderBy(RANK).rowsBetween(-(widest - 1), 0)
    # at most ``widest`` values; the key's own width of them, missing ones left out
    last = F.collect_list(F.struct("__v")).over(frame)
    out = blk.withColumn("__last", last).where(F.col(HOME))
    kept = F.transform(F.slice("__last", F.greatest(F.lit(1), F.size("__last") - F.col("w") + 1), F.col("w")), lambda s: s["__v"])
    out = out.withColumn("__last", F.filter(kept, lambda v: v.isNotNull()))
    full = F.size("__last") == F.col("w")
    mean = F.aggregate("__last", F.lit(0.0), lambda a, v: a + v) / F.col("w")
    out = out.withColumn("ma", F.when(full, mean))
    spread_sq = F.aggregate(F.transform("__last", lambda v: (v - F.col("ma")) * (v - F.col("ma"))), F.lit(0.0), lambda a, v: a + v)
    out = out.withColumn("std", F.when(full, F.sqrt(spread_sq / (F.col("w") - 1))))
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return out.select(*df.columns, "w", r(F.col("ma")).alias("ma"), r(F.col("std")).alias("std"),
                      r(F.col("ma") - F.col("std")).alias("band_lo"), r(F.col("ma") + F.col("std")).alias("band_hi"))


def series_overview(df: DataFrame, keys: list[str], ts: str, val: str, id_col: str,
                    w: int | None = None, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """R1 for the value column ``val``: a text time column is parsed (what
    does not parse is dropped, as are missing times) → (rolling band in time
    order, extremes).  Width by default from the length of each key's series."""
    if dict(df.dtypes)[ts] == "string":
        df = parse_date(df, ts, fmt=fmt)
    clean = df.where(F.col(ts).isNotNull())
    if w is None:
        band = rolling_by_key(clean, keys, ts, val, id_col)
    else:
        band = rolling_stats(clean, keys, ts, val, w, id_col)
    return band, peak_and_low(clean, keys, ts, val, id_col)
