"""Exact duplicates by content sort, with DataFrame functions only.

Rows are range-partitioned (Spark samples the splitters) by the first
characters of the normalised text and its digest, sorted in each partition
by the whole normalised text (external sort), and a window over the sorted
runs compares neighbours byte for byte and keeps the smallest identifier.
A text that alone holds more than a quarter of a partition's share of rows
is spread over several runs by a salt of its id; there are fewer than
``4 * partitions`` such texts, and their runs are put together by the SHA-256
digest of the text, whose counts were combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import ASCII_SPACE, shuffle_partitions


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     partitions: int | None = None, head_chars: int = 32) -> DataFrame:
    """Every row of ``df`` as the struct ``row`` plus keep_id, group_size, kept
    and text_sha256.

    Null text counts as empty.  Of equal texts the row with the smallest id
    stays (null ids last); of rows that repeat id and text one stays, all are
    counted in group_size.  The columns of ``df`` may have any names."""
    spark = df.sparkSession
    parts = partitions or shuffle_partitions(spark)
    rows = df.select(F.struct("*").alias("row"))
    doc_id, raw = F.col("row").getField(id_col), F.col("row").getField(text_col).cast("string")
    norm = F.regexp_replace(F.coalesce(raw, F.lit("")), ASCII_SPACE, " ")
    digest = F.sha2(norm, 256)

    # texts with more than a quarter of a partition's share: fewer than 4 * parts
    share = max(1, df.count() // (4 * parts))
    hot = (rows.select(digest.alias("hot_sha"), doc_id.alias("id")).groupBy("hot_sha")
           .agg(F.count(F.lit(1)).alias("all_n"), F.min("id").alias("all_id")).where(F.col("all_n") > share)
           .withColumn("salts", F.ceil(F.col("all_n") / share)))

    keyed = rows.select("row", F.substring(norm, 1, head_chars).alias("head"), digest.alias("sha"))
    salted = keyed.join(F.broadcast(hot), keyed["sha"] == F.col("hot_sha"), "left").select(
        "row", "head", "sha", "all_n", "all_id",
        F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(doc_id), F.col("salts"))).otherwise(F.lit(0)).alias("salt"))
    ranged = salted.repartitionByRange(parts, "head", "sha", "salt").withColumn("norm", norm)

    run = Window.partitionBy("head", "sha", "salt", "norm")
    runs = ranged.select(
        "row", "sha", "all_n", "all_id", doc_id.alias("id"), F.min(doc_id).over(run).alias("run_id"),
        F.count(F.lit(1)).over(run).alias("run_n"),
        F.row_number().over(run.orderBy(doc_id.asc_nulls_last())).alias("at"))
    keep = F.when(F.col("all_n").isNotNull(), F.col("all_id")).otherwise(F.col("run_id"))
    return runs.select(
        "row", keep.alias("keep_id"), F.coalesce("all_n", "run_n").alias("group_size"),
        ((F.col("at") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"), F.col("sha").alias("text_sha256"))
