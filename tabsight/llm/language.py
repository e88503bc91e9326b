"""Language of whole documents by string kernels.

A document is the set of its character n-grams (n = 1 to ``MAX_N``, lower
case), hashed to ``BUCKETS`` places; the kernel of two documents is the size
of the intersection of their sets over the geometric mean of the sets' sizes
(a blended-spectrum presence kernel).  Landmark documents give Nyström
features, and one-versus-rest ridge regression on these gives a weight per
landmark and language.  Documents are scored in batches: (presence matrix)
x (landmark presence matrix, transposed) x (weights); the last two factors
are multiplied once, as they do not depend on the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import held_out, text_udf

MAX_N = 4
BUCKETS = 1 << 17
STEP = 1 << 18  # characters hashed at a time
BLOCK = 1 << 13  # buckets of the kernel added up at a time
SAMPLE_PARTS = 64
UNKNOWN = "und"


def presence(text: str, flags: np.ndarray) -> None:
    """Set the flags of all n-grams of the whole text (cleared first)."""
    flags[:] = False
    text = text.lower()
    for at in range(0, len(text), STEP):  # parts overlap by MAX_N - 1 characters
        chars = np.frombuffer(text[at:at + STEP + MAX_N - 1].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        code = np.zeros(len(chars), np.uint64)
        for n in range(1, MAX_N + 1):
            if len(chars) < n:
                break
            code = code[:len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1:] + np.uint64(n << 40)
            flags[((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)).astype(np.int64)] = True


class KernelModel:
    """Weights per bucket and language; an empty list of languages predicts
    ``und`` everywhere."""

    def __init__(self, languages: list[str], places: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.places, self.weights, self.bias = languages, places, weights, bias

    def floor(self) -> float:
        """The score of a text that shares nothing with the landmarks: that of
        the largest bias.  As the targets of a document sum to 2 - C over the C
        languages, so do the raw outputs of any text, and the floor is 1/C or
        more.  With one language every text scores 1 and the floor is 0."""
        return float((self.bias.max() + 1) / 2) if len(self.languages) > 1 else 0.0

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
        import regex
        letter = regex.compile(r"\p{L}")
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and letter.search(t)] if self.languages else []
        flags = np.zeros(BUCKETS, bool)
        for at in range(0, len(todo), batch):
            part = todo[at:at + batch]
            rows, norm = np.zeros((len(part), len(self.places)), np.float32), np.ones(len(part), np.float32)
            for k, i in enumerate(part):
                presence(texts[i], flags)
                rows[k], norm[k] = flags[self.places], np.sqrt(np.count_nonzero(flags))
            f = (rows @ self.weights) / norm[:, None] + self.bias
            best = f.argmax(1)
            for k, i in enumerate(part):
                names[i] = self.languages[best[k]]
                scores[i] = float(min(1.0, max(0.0, (f[k, best[k]] + 1) / 2)))
        return names, scores


def fit_model(sample: list[tuple[str, np.ndarray]], landmarks: int, ridge: float = 1e-3) -> KernelModel:
    """``sample``: (language, sorted bucket numbers); the first ``landmarks``
    of each language are landmarks."""
    packed = np.zeros((len(sample), BUCKETS // 8), np.uint8)
    for k, (_, x) in enumerate(sample):
        flags = np.zeros(BUCKETS, bool)
        flags[x] = True
        packed[k] = np.packbits(flags)
    return fit_packed([y for y, _ in sample], packed, landmarks, ridge)


def fit_packed(spoken: list[str], packed: np.ndarray, landmarks: int, ridge: float = 1e-3) -> KernelModel:
    """``packed``: one row of bits (the buckets) for each document of the
    sample.  Kernel and weights are added up over blocks of buckets, so no
    matrix of documents x buckets is made."""
    languages = sorted(set(spoken))
    none = np.zeros(0, np.int64)
    if not languages:
        return KernelModel([], none, np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    taken: dict[str, int] = {}
    marks = []
    for i, y in enumerate(spoken):
        taken[y] = taken.get(y, 0) + 1
        if taken[y] <= landmarks:
            marks.append(i)

    def blocks():
        for at in range(0, packed.shape[1], BLOCK // 8):
            part = packed[:, at:at + BLOCK // 8]
            used = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(part[marks], axis=0)))
            yield 8 * at + used, np.unpackbits(part, axis=1)[:, used].astype(np.float32)
    shared = np.zeros((len(spoken), len(marks)))
    for _, z in blocks():
        shared += z @ z[marks].T
    norm = np.maximum(1, np.bitwise_count(packed).sum(1, dtype=np.int64)) ** 0.5
    k_nm = shared / np.outer(norm, norm[marks])
    values, vectors = np.linalg.eigh(k_nm[marks])
    good = values > 1e-8 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2)
    features = np.hstack([k_nm @ to_features, np.ones((len(spoken), 1))])
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for lang in spoken])
    penalty = ridge * len(spoken) * np.eye(features.shape[1])
    penalty[-1, -1] = 0
    beta = np.linalg.solve(features.T @ features + penalty, features.T @ y)
    by_mark = ((to_features @ beta[:-1]) / norm[marks][:, None]).astype(np.float32)
    parts = [(places, z[marks].T @ by_mark) for places, z in blocks()]
    return KernelModel(languages, np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]),
                       beta[-1].astype(np.float32))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int,
                    max_rows: int) -> tuple[list[str], np.ndarray]:
    """Languages and bucket flags (bits) of documents outside the held-out
    fold, in the order of a hash of id and language: at most ``per_language``
    of each language, and ``max_rows`` or one of each in all."""
    rows = docs.select(F.col(id_col).alias("did"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    usable = rows.where("did IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("did")))
    n_languages = usable.select("lang").distinct().count()
    each = share(per_language, max_rows, n_languages)
    # the first of each language, in two steps, so that a frequent language is not one task's
    h = F.xxhash64("did", "lang")
    ids = usable.select("did", "lang", F.pmod(h, F.lit(SAMPLE_PARTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(h, "did")
        ids = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    ids = ids.select("did").distinct()

    @F.pandas_udf("binary")
    def buckets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flags = np.zeros(BUCKETS, bool)
        for batch in texts:
            out = []
            for text in batch:
                presence(text, flags)
                out.append(np.packbits(flags).tobytes())
            yield pd.Series(out)

    picked = (usable.where("text IS NOT NULL").join(F.broadcast(ids), "did")
              .select("lang", "did", buckets("text").alias("x"))
              .orderBy(F.xxhash64("did", "lang"), "did", "lang", "x").limit(each * n_languages)).collect()
    bits = np.frombuffer(b"".join(r["x"] for r in picked), np.uint8).reshape(-1, BUCKETS // 8)
    return [r["lang"] for r in picked], bits


def share(per_language: int, in_all: int, n_languages: int) -> int:
    """A language's part of a budget for all languages; every language gets one."""
    return max(1, min(per_language, in_all // max(1, n_languages)))


def predictor(model: KernelModel):
    """Arrow-batched column function: text -> struct(lang_pred, score, floor)."""
    languages, places, weights, bias = model.languages, model.places, model.weights, model.bias
    floor = model.floor()

    def make():
        own = KernelModel(languages, places, weights, bias)
        return lambda texts: [{"lang_pred": y, "score": x, "floor": floor} for y, x in zip(*own.predict(texts))]
    return text_udf("lang_pred string, score double, floor double",
                    pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("floor", pa.float64())]), make)


def language_prediction(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                        per_language: int = 200, landmarks: int = 64, max_rows: int = 4000,
                        max_landmarks: int = 1024) -> Column:
    """Struct column (lang_pred, score, floor) of ``docs``' whole texts, the
    model being fitted on a bounded sample of them; ``floor`` is the score of a
    text that shares nothing with the languages learned.  Every language is
    learned: with many of them each has an equal share of ``max_rows``
    documents and ``max_landmarks`` landmarks, and the model has up to half a
    megabyte for each.  A null text or one without a letter is ``und`` with
    score 0, as is every text when no language can be learned; ties go to the
    first language by name."""
    spoken, bits = training_sample(docs, id_col, text_col, lang_col, per_language, max_rows)
    model = fit_packed(spoken, bits, share(landmarks, max_landmarks, len(set(spoken))))
    return predictor(model)(F.col(text_col).cast("string"))


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      **fit) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``docs``;
    null and repeated ids pass through, other columns are not read."""
    p = language_prediction(docs, id_col, text_col, lang_col, **fit)
    own = docs.select(F.col(id_col).alias("doc_id"), p.alias("p"))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")
