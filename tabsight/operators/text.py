"""Word counts, word weights, token statistics, TF-IDF.

Words are exploded to one row per (document, word) and counted with a
partial (map-side) aggregation, so a very frequent word is combined inside
each task before the shuffle.  Only bounded tables are broadcast: the fixed
stop list (as an ``isin`` expression) and the TF-IDF vocabulary (≤
``max_features`` rows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.session import spread
from tabsight.functions.text import ENGLISH_STOP_WORDS, STOP_WORDS_TOP, WORD_SPLIT, token_count


def word_counts(df: DataFrame, col: str, stop_words=STOP_WORDS_TOP, min_len: int = 3) -> DataFrame:
    """(word, count) over all rows of a text column."""
    # the word rule of ``word_tokens``, applied after the explode so that
    # whole-stage codegen fuses split, explode and filter (no per-row lambda)
    parts = F.split(F.lower(F.col(col)), WORD_SPLIT)
    words = (spread(df.select(col)).select(F.explode(parts).alias("word"))
             .where(F.col("word").rlike("^[a-z]{%d,}$" % min_len)))
    if stop_words:
        words = words.where(~F.col("word").isin(list(stop_words)))
    return words.groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def top_words(df: DataFrame, col: str, n: int = 20, stop_words=STOP_WORDS_TOP) -> DataFrame:
    """The ``n`` most frequent words (ties by word) → (word, count)."""
    return word_counts(df, col, stop_words).orderBy(F.desc("count"), "word").limit(n)


def word_weights(df: DataFrame, col: str, n: int = 250, stop_words=STOP_WORDS_TOP,
                 digits: int = 6) -> DataFrame:
    """Word-cloud table: top ``n`` words, weight = count / largest count."""
    top = top_words(df, col, n, stop_words)
    mx = top.agg(F.max("count").alias("__max"))  # over ≤ n rows
    return top.crossJoin(F.broadcast(mx)).select(
        "word", "count", F.round(F.col("count") / F.col("__max"), digits).alias("weight"))


def token_stats(df: DataFrame, col: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Whitespace-token statistics of a text column (optionally per group):
    rows, mean, min, max and total tokens (missing text ignored)."""
    t = F.when(F.col(col).isNotNull(), token_count(F.col(col)))
    aggs = [F.count(t).cast("bigint").alias("n_texts"), F.round(F.avg(t), digits).alias("mean_tokens"),
            F.min(t).cast("bigint").alias("min_tokens"), F.max(t).cast("bigint").alias("max_tokens"),
            F.sum(t).cast("bigint").alias("total_tokens")]
    return df.groupBy(*(by or [])).agg(*aggs)


def _parts(col: str):
    """Pieces of a text between non-word characters; short ones included."""
    return F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), WORD_SPLIT)


def _term_counts(df: DataFrame, col: str, stop) -> DataFrame:
    """(term, n): corpus counts of the terms of two or more characters; split,
    explode and filter are fused, and counts are combined before the shuffle."""
    terms = spread(df.select(col)).select(F.explode(_parts(col)).alias("term")).where(F.char_length("term") >= 2)
    if stop:
        terms = terms.where(~F.col("term").isin(list(stop)))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _doc_freq(df: DataFrame, col: str, terms: list[str]) -> dict[str, int]:
    """Number of rows that hold each of ``terms``: a row gives each of its
    distinct terms once, so no (document, term) pair is shuffled."""
    mine = F.array_intersect(F.array(*[F.lit(t) for t in terms]), _parts(col))
    rows = spread(df.select(col)).select(F.explode(mine).alias("term")).groupBy("term").count().collect()
    return {r["term"]: r["count"] for r in rows}  # ≤ max_features rows


def tfidf_vocabulary(df: DataFrame, col: str, max_features: int = 300, stop_words=None) -> DataFrame:
    """Top ``max_features`` terms by corpus count (ties by term) →
    (term, term_index, n, dfreq) — ≤ ``max_features`` rows.  ``stop_words``:
    any list of words to leave out (default: Spark ML's English list)."""
    stop = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    top = _term_counts(df, col, stop).orderBy(F.desc("n"), "term").limit(max_features).collect()
    freq = _doc_freq(df, col, [r["term"] for r in top]) if top else {}
    return df.sparkSession.createDataFrame([(r["term"], i, r["n"], freq[r["term"]]) for i, r in enumerate(top)],
                                           "term string, term_index int, n long, dfreq long")


@dataclass
class Tfidf:
    """A fitted vocabulary: terms in index order and their smoothed idf
    (≤ ``max_features`` numbers)."""

    terms: list[str]
    idf: list[float]

    def vectors(self, df: DataFrame, col: str, out: str = "tfidf") -> DataFrame:
        """Add the L2-normalised vector of every row's text: a
        ``CountVectorizerModel`` over the vocabulary, ``ElementwiseProduct``
        by the idf and ``Normalizer`` — row-local, no shuffle."""
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors
        vec = df.withColumn("__tok", _parts(col))  # terms of one character are in no vocabulary
        for stage in (CountVectorizerModel.from_vocabulary(self.terms, inputCol="__tok", outputCol="__tf"),
                      ElementwiseProduct(inputCol="__tf", outputCol="__w", scalingVec=Vectors.dense(self.idf)),
                      Normalizer(inputCol="__w", outputCol=out, p=2.0)):
            vec = stage.transform(vec)
        return vec.drop("__tok", "__tf", "__w")


def fit_tfidf(df: DataFrame, col: str, max_features: int = 300, stop_words=None,
              vocabulary: DataFrame | None = None, n_docs: int | None = None) -> Tfidf:
    """Vocabulary and idf = ln((1 + n) / (1 + df)) + 1 from ``df``, or from a
    given ``vocabulary`` (term, term_index[, dfreq]); without ``dfreq`` the
    document frequencies are counted on ``df``."""
    stop = list(ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    n = n_docs if n_docs is not None else df.count()
    vocab = vocabulary if vocabulary is not None else tfidf_vocabulary(df, col, max_features, stop)
    rows = vocab.orderBy("term_index").collect()  # ≤ max_features rows
    terms = [r["term"] for r in rows]
    if not terms:
        return Tfidf([], [])
    dfreq = ({r["term"]: r["dfreq"] for r in rows} if "dfreq" in vocab.columns else
             _doc_freq(df, col, terms))
    return Tfidf(terms, [math.log((1 + n) / (1 + dfreq.get(t, 0))) + 1 for t in terms])


def tfidf_long(df: DataFrame, id_col: str, col: str, max_features: int = 300,
               stop_words=None, vocabulary: DataFrame | None = None, n_docs: int | None = None,
               digits: int = 6) -> DataFrame:
    """TF-IDF in long form → (id, term, weight).

    tf = raw count, idf = ln((1 + n) / (1 + df)) + 1 (smoothed), each
    document's vector L2-normalised over the vocabulary.  Pass a fitted
    ``vocabulary`` (term, term_index[, dfreq]) and ``n_docs`` to apply a
    training-set fit to new rows.  Two aggregations (term counts, then document
    frequencies of the vocabulary) and a map-only pass, of which only the
    non-zero entries of a row's vector are unpacked."""
    from pyspark.ml.functions import vector_to_array
    df = df.select(id_col, col)
    model = fit_tfidf(df, col, max_features, stop_words, vocabulary, n_docs)
    if not model.terms:
        return df.sparkSession.createDataFrame([], f"{id_col} {df.schema[id_col].dataType.simpleString()}, "
                                                   "term string, weight double")
    weights = vector_to_array("tfidf")
    entries = F.filter(F.transform(weights, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda e: e["w"] > 0)
    long = model.vectors(spread(df), col).select(id_col, F.inline(entries))
    return long.select(id_col, F.get(F.array(*[F.lit(t) for t in model.terms]), F.col("i")).alias("term"),
                       F.round("w", digits).alias("weight"))


def attach_features(df: DataFrame, id_col: str, col: str, max_features: int = 300, stop_words=None,
                    fit: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The table with its text column replaced by the TF-IDF vector
    (column ``tfidf``), fitted on ``fit`` (default: the rows given); also
    returns the terms in vector order."""
    model = fit_tfidf(df if fit is None else fit, col, max_features, stop_words)
    if not model.terms:
        return df.drop(col), []
    return model.vectors(df, col).drop(col), model.terms
