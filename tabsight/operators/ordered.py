"""Exact row order inside a series without putting a series in one task.

``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one task;
if one key (or one time value) holds a third of the table, so does that task.
``ordered_rank`` gives the same 1-based row number from a range partitioning:

1. rows are dealt to ranges of (keys, order value, tiebreak) — Spark samples
   the splitters, so ranges hold about equally many rows however the keys and
   times are distributed — and sorted inside each range;
2. a row's place is its partition number and its place in the partition
   (``monotonically_increasing_id``); the result is checkpointed, because a
   second sampling could draw other splitters;
3. partition sizes (one row per partition) become offsets, and a key's rank
   is the place minus the place of the key's first row.

``with_blocks`` then cuts the ranked series into fixed blocks of ``block``
rows and copies the last ``halo`` rows of each block into the next one, so
rolling frames and lags of up to ``halo`` rows are exact inside each block.
NULL keys are a series like any other; NULL order values come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.session import cut_lineage

RANK = "__rank"
BLOCK = "__block"
HOME = "__home"
PART_BITS = 33  # monotonically_increasing_id keeps the partition above these


def order_value(df: DataFrame, col: str) -> Column:
    """Order column as a number (timestamps as microseconds)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_micros(F.col(col).cast("timestamp"))
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(col))
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(col)).cast("long")
    return F.col(col).cast("double")


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL; the right side's keys are
    dropped.  Without keys the right side is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    other = right.select(*[F.col(c).alias(f"__k_{keys.index(c)}" if c in keys else c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__k_{i}"]) for i, k in enumerate(keys)])
    return left.join(other, cond, how).drop(*[f"__k_{i}" for i in range(len(keys))])


def ordered_rank(df: DataFrame, keys: list[str], order_col: str, tiebreak: list[str] | None = None,
                 partitions: int | None = None, with_count: bool = True) -> DataFrame:
    """Add ``__rank`` (1-based row number per key ordered by ``order_col``
    then ``tiebreak``, NULLs first) and, if asked, ``__n`` (rows of the key).
    Rows that agree in all of these are put in order by a hash of the row."""
    keys, tiebreak = list(keys), list(tiebreak or [])
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashable = [c for c, t in df.dtypes if "map<" not in t]
    base = df.withColumns({"__o": order_value(df, order_col), "__h": F.xxhash64(*[F.col(f"`{c}`") for c in hashable])})
    order = [*keys, "__o", *tiebreak, "__h"]
    placed = cut_lineage(base.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("__at", F.monotonically_increasing_id()))
    numbered = _places(placed)
    firsts = numbered.groupBy(*keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    out = join_keys(numbered, firsts, keys).withColumn(RANK, F.col("__at") - F.col("__first") + 1)
    return out.drop("__o", "__h", "__at", "__first", *([] if with_count else ["__n"]))


def dense_codes(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """(value, code): the distinct non-missing values of a column numbered
    0, 1, … in their sort order, without a window over all of them and
    without bringing them to the driver."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct()
    placed = cut_lineage(values.repartitionByRange(n, "value").sortWithinPartitions("value")
                         .withColumn("__at", F.monotonically_increasing_id()))
    return _places(placed).select("value", F.col("__at").cast("int").alias("code"))


def _places(placed: DataFrame) -> DataFrame:
    """Turn ``__at`` (partition above, place in it below) into the place in
    the whole table; the sizes of the partitions are one row each."""
    part = F.shiftright(F.col("__at"), PART_BITS)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__off"))
    place = F.col("__off") + F.col("__at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return placed.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn("__at", place).drop("__p", "__off")


def with_blocks(ranked: DataFrame, halo: int, block_rows: int = 1_000_000) -> DataFrame:
    """Assign ``__block`` = (rank-1) // block_rows and duplicate the last
    ``halo`` rows of every block into the next one; ``__home`` marks the
    copy that belongs to its own block (keep only those after the window)."""
    size = max(int(block_rows), int(halo) + 1)
    b = F.floor((F.col(RANK) - 1) / size).cast("long")
    pos = (F.col(RANK) - 1) % size
    blocks = F.when((F.lit(halo) > 0) & (pos >= size - halo), F.array(b, b + 1)).otherwise(F.array(b))
    return (ranked.withColumn(BLOCK, F.explode(blocks))
            .withColumn(HOME, F.col(BLOCK) == b))
