"""Corpus pipeline: quality, language, exact duplicates, near duplicates, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import exact_dedup, language, ngram_join, packing, quality
from tabsight.llm.common import shared_checkpoint
from tabsight.session import checkpoint_dir

QUALITY_LEAST = 0.3  # least score of a document that stays
#: Least score of the language found, as a share of the way from the score of
#: a text that shares nothing with the languages learned (1/C or more with C of
#: them) up to 1.  On the held-out documents of sf0.1 it rejects 1 of 703 of
#: good quality (a text of 7 characters), 1 of 1,960 in all.
LANGUAGE_LEAST = 0.15


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(quality.quality_score(docs, labels) >= QUALITY_LEAST)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned: not ``und``, and with a
    score clearly above that of a text that shares nothing with them.  If only
    one language can be learned, nothing but ``und`` is rejected."""
    found = language.language_prediction(docs)
    least = F.col("__found.floor") + LANGUAGE_LEAST * (1 - F.col("__found.floor"))
    return (docs.withColumn("__found", found)
            .where((F.col("__found.lang_pred") != language.UNKNOWN) & (F.col("__found.score") >= least))
            .drop("__found"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    return exact_dedup.exact_duplicates(docs).where("kept").select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id;
    documents without an id or without words stay.  Of rows that share that
    id, the one with the smallest hash of its text stays, and of equal texts
    too, the one with the smallest hash of the row; a row of another group
    stays whatever its id."""
    key = F.xxhash64(F.col("text").cast("string"))
    rows = ngram_join.labelled_rows(docs).where("comp IS NOT NULL AND doc_id IS NOT NULL")
    rows = shared_checkpoint(rows.groupBy("comp", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")))
    kept = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "text_key")).alias("kept"))
    gone = (rows.join(kept, "comp").where(F.struct("doc_id", "text_key") != F.col("kept"))
            .select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text_key")))
    same = (docs["doc_id"] == F.col("__gone")) & (key == F.col("__text_key"))
    stay = docs.join(gone, same, "left_anti")
    again = rows.where("n > 1").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text_key"))
    if again.isEmpty():
        return stay
    row = F.struct(*docs.columns)
    one = (stay.join(again, same, "left_semi").groupBy("doc_id", key.alias("__text_key"))
           .agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("__row")).select("__row.*"))
    return stay.join(again, same, "left_anti").unionByName(one)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.with_checksums(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", quality_stage), ("language ID", language_stage), ("exact dedup", exact_stage),
          ("n-gram Jaccard join", near_stage), ("packing", packing_stage)]

#: The classifiers and the packing are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two of them is a
    Parquet table in the folder that spark.checkpoint.dir names."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{at}")
        docs = spark.read.parquet(f"{base}/{at}")
    return STAGES[-1][1](spark, docs, sf_dir)
