"""Quality of whole documents from a linear-chain conditional random field.

Every line is labelled good or bad from features of itself and of its two
neighbouring lines; forward-backward gives each line's probability of being
good, and the document's score is their mean weighted by line length.  The
field is fitted on a bounded sample of labelled documents whose lines inherit
the document's label: per-line features are made in the tasks and at most
``max_docs`` documents of ``max_lines`` lines each reach the driver.  Of a
document with more lines, runs of ``RUN`` neighbouring lines from anywhere in
the text are taken, chosen by a hash of the document's id and the run's number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log1p
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import held_out, text_udf

LETTERS = bytes(range(65, 91)), bytes(range(97, 123))
CLASSES = (LETTERS[0], b"0123456789", b"!", b"|", b"#$%&*@~^=+<>{}[]\\_`/", b".,;:?", b"\"'()-", bytes(range(128, 256)))
N_RAW = 7 + len(CLASSES)
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)  # cut points of a feature: these, and
SHARES = (0.25, 0.5, 0.75)  # these shares of its range, for features that are nearly always equal
N_BINS = len(QUANTILES) + len(SHARES) + 1
RUN = 16  # neighbouring lines taken from a long document


# ------------------------------------------------------------- line features
def lines_of(text: str | None) -> list[str]:
    """Lines with something else than white space on them."""
    return [s for s in text.split("\n") if s and not s.isspace()] if text else []


def line_features(lines: list[str], seen: Counter) -> np.ndarray:
    """One row per line: word count and length, shares of distinct and of
    repeated neighbouring words, shares of character classes, sentence end,
    and whether the line occurs again in its document."""
    rows = []
    for s in lines:
        words = s.split()
        n = len(words)
        b = s.encode("utf-8", "replace")
        size = len(b)
        rows.append((log1p(n), size / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
                     1.0 if s.rstrip()[-1] in ".!?" else 0.0, 1.0 if seen[s] > 1 else 0.0, log1p(size),
                     *[(size - len(b.translate(None, c))) / size for c in CLASSES]))
    return np.array(rows, np.float32).reshape(len(rows), N_RAW)


OWN = N_RAW * N_BINS  # binned features of one line
NOTHING = 3 * OWN + 3  # place of a weight that stays 0


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Places of the weights that add up to a line's log odds: its own binned
    features, those of the line before and after, two flags for the ends of
    the text and a constant."""
    n = len(own)
    out = np.full((n, 3 * N_RAW + 3), NOTHING)
    out[:, :N_RAW] = own
    out[1:, N_RAW:2 * N_RAW] = own[:-1] + OWN
    out[:-1, 2 * N_RAW:3 * N_RAW] = own[1:] + 2 * OWN
    out[0, -3], out[-1, -2], out[:, -1] = 3 * OWN, 3 * OWN + 1, 3 * OWN + 2
    return out


class LineField:
    """Fitted field: cut points for each raw feature, a weight per binned
    feature (log odds of good), and log transition weights."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray, moves: np.ndarray):
        self.cuts, self.weights, self.moves = cuts, weights, moves

    def binned(self, raw: np.ndarray) -> np.ndarray:
        return np.stack([j * N_BINS + np.searchsorted(self.cuts[j], raw[:, j], side="left") for j in range(N_RAW)], axis=1)

    def log_odds(self, lines: list[str], block: int = 8192) -> list[float]:
        """Node log odds of every line, in blocks with one line of overlap."""
        seen, out = Counter(lines), []
        for at in range(0, len(lines), block):
            lo, hi = max(0, at - 1), min(len(lines), at + block + 1)
            x = with_neighbours(self.binned(line_features(lines[lo:hi], seen)))
            if lo:
                x[0, -3] = NOTHING
            if hi < len(lines):
                x[-1, -2] = NOTHING
            out += self.weights[x].sum(axis=1)[at - lo:at - lo + min(block, len(lines) - at)].tolist()
        return out

    def marginals(self, odds: list[float]) -> list[float]:
        """Each line's probability of being good: forward-backward over the
        two labels, normalised at every line."""
        (e00, e01), (e10, e11) = np.exp(self.moves).tolist()
        g = [exp(max(-60.0, min(60.0, u))) for u in odds]
        n = len(g)
        ahead = [0.0] * n
        p = g[0] / (1 + g[0])
        ahead[0] = p
        for t in range(1, n):
            q = 1 - p
            a, b = (q * e01 + p * e11) * g[t], q * e00 + p * e10
            p = ahead[t] = a / (a + b)
        good, bad = 1.0, 1.0
        out = [0.0] * n
        for t in range(n - 1, -1, -1):
            p = ahead[t]
            a, b = p * good, (1 - p) * bad
            out[t] = a / (a + b) if a + b > 0 else p
            a, b = good * g[t], bad
            good, bad = e10 * b + e11 * a, e00 * b + e01 * a
            s = good + bad
            good, bad = good / s, bad / s
        return out

    def score(self, text: str | None) -> float:
        """Length-weighted mean of the marginals; 0 for a text without lines."""
        lines = lines_of(text)
        if not lines:
            return 0.0
        p = self.marginals(self.log_odds(lines))
        size = [len(s) for s in lines]
        return min(1.0, max(0.0, sum(a * b for a, b in zip(p, size)) / sum(size)))


# -------------------------------------------------------------------- fitting
class Piece(NamedTuple):
    """Raw features of neighbouring lines; the first (``before``) and the last
    (``after``) are not part of it but give their features to their neighbours."""

    raw: np.ndarray
    label: int
    before: bool = False
    after: bool = False

    @property
    def size(self) -> int:
        return len(self.raw) - self.before - self.after

    def places(self, field: LineField) -> np.ndarray:
        x = with_neighbours(field.binned(self.raw))
        if self.before:
            x[0, -3] = NOTHING
            x[1, -3] = NOTHING
        if self.after:
            x[-1, -2] = NOTHING
            x[-2, -2] = NOTHING
        return x[self.before:len(x) - self.after]


def sampled_runs(n: int, max_lines: int, seed: int) -> list[tuple[int, int]]:
    """Ranges of the lines to learn from: all ``n``, or, of a longer document,
    runs of ``RUN`` lines with the smallest hashes, ``max_lines`` in all."""
    if n <= max_lines:
        return [(0, n)] if n else []
    size = min(RUN, max_lines)
    runs = range(-(-n // size))
    chosen = sorted(runs, key=lambda r: xxhash.xxh3_64_intdigest(f"{seed}:{r}"))[:max(1, max_lines // size)]
    return [(r * size, min(n, (r + 1) * size)) for r in sorted(chosen)]


def cut_points(raw: np.ndarray) -> np.ndarray:
    lo, hi = raw.min(axis=0), raw.max(axis=0)
    wide = lo[None] + np.array(SHARES)[:, None] * (hi - lo)[None]
    return np.sort(np.concatenate([np.quantile(raw, QUANTILES, axis=0), wide]), axis=0).T.copy()


def fit_field(pieces: list[Piece], steps: int = 250, rate: float = 0.1,
              ridge: float = 1e-4) -> LineField:
    """Maximum conditional likelihood by full-batch Adam; ``pieces`` are those
    of the bounded sample.  Without documents of both labels every line gets
    the share of good ones."""
    pieces = [p for p in pieces if p.size]
    ys = {p.label for p in pieces}
    cuts = np.zeros((N_RAW, N_BINS - 1))
    dim = NOTHING + 1
    if len(ys) < 2:
        w = np.zeros(dim)
        w[-2] = 8.0 if 1 in ys else (-8.0 if ys else 0.0)
        return LineField(cuts, w, np.zeros((2, 2)))
    cuts = cut_points(np.concatenate([p.raw for p in pieces]))
    field = LineField(cuts, np.zeros(dim), np.zeros((2, 2)))
    pieces.sort(key=lambda p: -p.size)
    n, steps_t = len(pieces), pieces[0].size
    x = np.concatenate([p.places(field) for p in pieces])
    size = np.array([p.size for p in pieces])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    y = np.array([p.label for p in pieces])
    alive = [int((size > t).sum()) for t in range(steps_t)]  # documents are sorted by length
    theta = np.zeros(dim + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    target_moves = np.zeros((2, 2))
    for label in (0, 1):
        target_moves[label, label] = (size[y == label] - 1).sum()
    label_of_line = np.repeat(y, size)
    for step in range(1, steps + 1):
        w, moves = theta[:dim], theta[dim:].reshape(2, 2)
        u = w[x].sum(axis=1)
        alpha, beta = np.zeros((steps_t, n, 2)), np.zeros((steps_t, n, 2))
        alpha[0, :, 1] = u[first]
        for t in range(1, steps_t):
            k = alive[t]
            prev = alpha[t - 1, :k, :, None] + moves[None]
            alpha[t, :k] = np.logaddexp(prev[:, 0], prev[:, 1])
            alpha[t, :k, 1] += u[first[:k] + t]
        p_good, moved = np.zeros(len(x)), np.zeros((2, 2))
        for t in range(steps_t - 1, -1, -1):
            k = alive[t]
            joint = alpha[t, :k] + beta[t, :k]
            z = np.logaddexp(joint[:, 0], joint[:, 1])
            p_good[first[:k] + t] = np.exp(joint[:, 1] - z)
            if t:
                own = beta[t, :k].copy()
                own[:, 1] += u[first[:k] + t]
                pair = alpha[t - 1, :k, :, None] + moves[None] + own[:, None, :]
                moved += np.exp(pair - z[:, None, None]).sum(0)
                step_back = moves[None] + own[:, None, :]
                beta[t - 1, :k] = np.logaddexp(step_back[:, :, 0], step_back[:, :, 1])
        by_weight = np.bincount(x.ravel(), np.repeat(label_of_line - p_good, x.shape[1]), dim)
        by_weight[NOTHING] = 0.0
        grad = np.concatenate([by_weight, (target_moves - moved).ravel()]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return LineField(cuts, theta[:dim], theta[dim:].reshape(2, 2))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_docs: int,
                    max_lines: int) -> list[Piece]:
    """Pieces of at most ``max_docs`` labelled documents outside the held-out
    fold, in the order of a hash of their id (repeated labels of an id: the
    smallest; null labels and ids are left out)."""
    chosen = (labels.select(F.col("doc_id").alias("lid"), F.col("quality").cast("int").alias("y"))
              .where("lid IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("lid")))
              .groupBy("lid").agg(F.min("y").alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(max_docs))

    @F.pandas_udf("array<struct<raw:binary,before:boolean,after:boolean>>")
    def features(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, seeds in columns:
            out = []
            for text, seed in zip(texts, seeds):
                lines = lines_of(text)
                seen, pieces = Counter(lines), []
                for a, b in sampled_runs(len(lines), max_lines, seed):
                    lo, hi = max(0, a - 1), min(len(lines), b + 1)
                    pieces.append({"raw": line_features(lines[lo:hi], seen).tobytes(), "before": lo < a, "after": hi > b})
                out.append(pieces)
            yield pd.Series(out)

    seed = F.xxhash64("did")
    picked = (docs.select(F.col(id_col).alias("did"), F.col(text_col).cast("string").alias("text"))
              .join(F.broadcast(chosen), F.col("did") == F.col("lid"))
              .select("did", "y", features("text", seed).alias("pieces"))
              .orderBy(seed, "did", F.col("pieces.raw")).limit(max_docs))
    return [Piece(np.frombuffer(p["raw"], np.float32).reshape(-1, N_RAW), r["y"], p["before"], p["after"])
            for r in picked.collect() for p in r["pieces"]]


def scorer(field: LineField):
    """Arrow-batched column function: text -> score."""
    cuts, weights, moves = field.cuts, field.weights, field.moves

    def make():
        own = LineField(cuts, weights, moves)
        return lambda texts: [own.score(t) for t in texts]
    return text_udf("double", pa.float64(), make)


def quality_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_docs: int = 4000, max_lines: int = 64) -> Column:
    """Column with the score of ``docs``' whole texts (0 to 1), the field being
    fitted on the labelled ones among them.  A null, empty or blank text
    scores 0; no labels at all score 0.5 each line."""
    field = fit_field(training_sample(docs, labels, id_col, text_col, max_docs, max_lines))
    return scorer(field)(F.col(text_col).cast("string"))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     threshold: float = 0.3, **fit) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``;
    null and repeated ids pass through, other columns are not read."""
    score = quality_score(docs, labels, id_col, text_col, **fit)
    own = docs.select(F.col(id_col).alias("doc_id"), score.alias("score"))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
