"""Cross-validated tuning with shared passes over the rows.

A grid of k folds and g parameter values is k * g fits (and g refits), but the
fits read the same rows:

* **Ridge.** One scan adds up, for each fold, the Gram matrix of (1, x, y).
  The training part of a fold is the total minus the fold's matrix, the
  solution for every alpha is a small linear system, and the R2 on the fold
  follows from the fold's own matrix.  One scan for any grid.
* **Logistic regression.** All (C, fold) problems and the refits on all rows
  run their L-BFGS steps together: a pass computes loss and gradient of every
  problem still running, each at its own point.  The number of passes is that
  of the slowest problem, whatever the size of the grid; one more pass scores
  all folds.

* **Random forests.** The first n trees of a forest are a forest of n trees,
  and a tree cut at depth d is a tree grown to depth d.  One forest per fold,
  with the most trees and levels of the grid, scores every (trees, depth).

The rows are kept as blocks of numbers; sums have the size of the model times
the grid and are added up in two steps (``boosting.tree_sum``).
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.boosting import _blob, _matrix, tree_sum
from tabsight.operators.features import hash_bucket
from tabsight.session import ship_package, spread

ROWS = "n int, x binary, y binary, fold binary"


def fold_of(df: DataFrame, id_col: str, folds: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """``df`` with a fold from 0 by a hash of the row's id."""
    return df.withColumn(out, hash_bucket(id_col, seed + 1, folds))


def _to_blocks(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch.column(0), d)])
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            fold = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x)], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, y, fold))],
                names=["n", "x", "y", "fold"])
    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for n, x, y, fold in zip(*(c.to_pylist() for c in batch.columns)):
            yield np.frombuffer(x, float).reshape(n, -1), np.frombuffer(y, float), np.frombuffer(fold, np.int32)


def _summed(blocks: DataFrame, one) -> np.ndarray:
    """Sum over all blocks of ``one(x, y, fold)``, an array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, y, fold in _opened(batches):
            own = one(x, y, fold)
            total = own if total is None else total + own
        if total is not None:
            yield _blob(total)
    return tree_sum(blocks.mapInArrow(run, "x binary"))


def _blocks(df: DataFrame, features: str, label: str, fold: str) -> tuple[DataFrame, int]:
    from pyspark.ml.functions import vector_to_array
    ship_package(df.sparkSession)
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("f"))
    rows = rows.where("y IS NOT NULL AND f IS NOT NULL")
    first = rows.first()
    if first is None:
        raise ValueError("no row with a label and a fold")
    d = len(first["x"])
    return spread(rows).mapInArrow(_to_blocks(d), ROWS), d


# ---------------------------------------------------------------------- ridge
def gram_matrices(df: DataFrame, features: str, label: str, fold: str, folds: int) -> np.ndarray:
    """folds x (d + 2) x (d + 2): sums of products of (1, x, y), one scan."""
    blocks, d = _blocks(df, features, label, fold)

    def one(x, y, f):
        z = np.hstack([x, y[:, None]])
        return np.stack([z[f == k].T @ z[f == k] for k in range(folds)])
    return np.asarray(_summed(blocks, lambda *a: one(*a).ravel())).reshape(folds, d + 2, d + 2)


def ridge_solution(gram: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, weights) of min |y - b - xw|^2 + alpha |w|^2."""
    n, sx, sy = gram[0, 0], gram[0, 1:-1], gram[0, -1]
    xx = gram[1:-1, 1:-1] - np.outer(sx, sx) / n
    w = np.linalg.lstsq(xx + alpha * np.eye(len(sx)), gram[1:-1, -1] - sx * sy / n, rcond=None)[0]
    return np.append((sy - sx @ w) / n, w)


def r2_from_gram(gram: np.ndarray, w: np.ndarray) -> float:
    """R2 of intercept and weights ``w`` on the rows behind ``gram``."""
    v = np.append(w, -1.0)
    total = gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0]
    return float(1 - (v @ gram @ v) / total) if total > 0 else float("nan")


def tune_ridge(df: DataFrame, alphas: list[float], features: str = "features", label: str = "label", fold: str = "fold",
               folds: int = 3) -> tuple[float, list[tuple[float, float]], np.ndarray]:
    """(best alpha, [(alpha, mean R2 over the folds)], its solution on all
    rows).  ``fold`` holds 0 … folds - 1; the first of equal scores wins."""
    grams = gram_matrices(df, features, label, fold, folds)
    total, scores = grams.sum(axis=0), []
    used = [k for k in range(folds) if grams[k, 0, 0] > 0]
    for alpha in alphas:
        scores.append((alpha, float(np.mean([r2_from_gram(grams[k], ridge_solution(total - grams[k], alpha)) for k in used]))))
    best = max(scores, key=lambda s: s[1])[0]
    return best, scores, ridge_solution(total, best)


# ------------------------------------------------------------------- logistic
def lbfgs(start: np.ndarray, rounds: int = 200, tol: float = 1e-7, memory: int = 10) -> Generator[np.ndarray, tuple, np.ndarray]:
    """Minimise a smooth convex function: yields a point, is sent (value,
    gradient) there, and ends with the best point."""
    x = start
    f, g = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= tol * max(1.0, abs(f)):
            break
        q, undo = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            undo.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(undo)):
            q += s * (a - (y @ q) / (s @ y))
        step, slope = 1.0, -(g @ q)
        while True:
            new = x - step * q
            new_f, new_g = yield new
            if new_f <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step *= 0.3
        if not new_f < f:
            break
        s, y = new - x, new_g - g
        if s @ y > 1e-14:
            pairs = (pairs + [(s, y)])[-memory:]
        x, f, g = new, new_f, new_g
    return x


def _log_losses(points: list[np.ndarray], skip: list[int], classes: int, outputs: int, scored: bool):
    """For each problem (its point, and the fold it leaves out or -1) sums
    over its rows: loss and gradient; or, if ``scored``, over the fold left
    out: right answers and rows."""
    def run(x, y, fold):
        z = x @ np.hstack([p.reshape(x.shape[1], outputs) for p in points])
        out = []
        for k, s in enumerate(skip):
            m = z[:, k * outputs:(k + 1) * outputs]
            if scored:
                here = fold == s
                guess = (m[:, 0] > 0).astype(float) if outputs == 1 else m.argmax(axis=1)
                out.append([(guess[here] == y[here]).sum(), here.sum()])
                continue
            live = fold != s
            if outputs == 1:
                loss = np.logaddexp(0, m[:, 0]) - y * m[:, 0]
                residual = (1 / (1 + np.exp(-np.clip(m, -500, 500))) - y[:, None]) * live[:, None]
            else:
                top = m.max(axis=1, keepdims=True)
                e = np.exp(m - top)
                total = e.sum(axis=1, keepdims=True)
                own = y.astype(int)
                loss = (np.log(total) + top)[:, 0] - m[np.arange(len(y)), own]
                residual = (e / total - (own[:, None] == np.arange(classes))) * live[:, None]
            out.append(np.append((loss * live).sum(), (x.T @ residual).ravel()))
        return np.concatenate(out)
    return run


def tune_logistic(df: DataFrame, cs: list[float], features: str = "features", label: str = "label", fold: str = "fold",
                  folds: int = 3, rounds: int = 500) -> tuple[float, list[tuple[float, float]], np.ndarray, int]:
    """(best C, [(C, mean accuracy over the folds)], its solution on all rows
    as (1 + d) x outputs, passes over the rows).

    Two classes have one output, more have one each (softmax); the penalty is
    |w|^2 / (2 C) against the sum of the losses, without the intercept.
    ``label`` holds 0.0 … K - 1, ``fold`` 0 … folds - 1; the first of equal
    scores wins."""
    blocks, d = _blocks(df, features, label, fold)
    blocks = blocks.persist()
    try:
        sizes = _summed(blocks, lambda x, y, f: np.bincount(f, minlength=folds).astype(float))
        classes = int(df.agg(F.max(label)).first()[0]) + 1
        outputs = 1 if classes <= 2 else classes
        problems = [(c, s) for c in cs for s in [*range(folds), -1]]
        n = {s: sizes.sum() - (sizes[s] if s >= 0 else 0) for s in [*range(folds), -1]}
        flat = np.zeros((1 + d) * outputs)
        searches = {k: lbfgs(flat, rounds) for k in range(len(problems))}
        points = {k: next(g) for k, g in searches.items()}
        solved, passes = {}, 0
        while points:
            asked = sorted(points)
            got = _summed(blocks, _log_losses([points[k] for k in asked], [problems[k][1] for k in asked], classes, outputs, False))
            passes += 1
            for k, own in zip(asked, got.reshape(len(asked), -1)):
                c, s = problems[k]
                rows = max(1.0, n[s])
                w = points[k].reshape(1 + d, outputs).copy()
                w[0] = 0
                value = own[0] / rows + (w * w).sum() / (2 * c * rows)
                try:
                    points[k] = searches[k].send((value, own[1:] / rows + w.ravel() / (c * rows)))
                except StopIteration as end:
                    solved[k] = end.value
                    del points[k]
        held = [k for k, (_, s) in enumerate(problems) if s >= 0]
        right = _summed(blocks, _log_losses([solved[k] for k in held], [problems[k][1] for k in held], classes, outputs, True))
        by_c: dict[float, list[float]] = {}
        for k, (good, rows) in zip(held, right.reshape(-1, 2)):
            if rows:
                by_c.setdefault(problems[k][0], []).append(good / rows)
        scores = [(c, float(np.mean(by_c[c]))) for c in cs]
        best = max(scores, key=lambda s: s[1])[0]
        return best, scores, solved[problems.index((best, -1))].reshape(1 + d, outputs), passes + 1
    finally:
        blocks.unpersist()


# -------------------------------------------------------------------- forests
def _arrays(nodes: dict[int, dict], classes: int | None) -> tuple[np.ndarray, ...]:
    """(feature or -1, threshold, left, right, value) of a tree's nodes."""
    ids = sorted(nodes)
    at = {i: k for k, i in enumerate(ids)}
    feature, edge = np.full(len(ids), -1), np.zeros(len(ids))
    left, right = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    value = np.zeros((len(ids), classes or 1))
    for k, i in enumerate(ids):
        node = nodes[i]
        value[k] = np.array(node["impurityStats"]) / sum(node["impurityStats"]) if classes else node["impurityStats"][1] / node["impurityStats"][0]
        if node["leftChild"] >= 0:
            if node["split"]["numCategories"] >= 0:
                raise ValueError("categorical features are not tuned in shared fits")
            feature[k], edge[k] = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            left[k], right[k] = at[node["leftChild"]], at[node["rightChild"]]
    return feature, edge, left, right, value


def values_by_depth(tree: tuple[np.ndarray, ...], x: np.ndarray, depths: list[int]) -> list[np.ndarray]:
    """The rows' values in the tree cut at each of the ascending ``depths``."""
    feature, edge, left, right, value = tree
    at, rows, out = np.zeros(len(x), np.int64), np.arange(len(x)), []
    for depth in range(depths[-1] + 1):
        if depth in depths:
            out.append(value[at])
        inner = feature[at] >= 0
        if not inner.any():
            break
        goes_left = x[rows, np.maximum(feature[at], 0)] <= edge[at]
        at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
    return out + [value[at]] * (len(depths) - len(out))


def tune_forest(df: DataFrame, kind: str, trees: list[int], depths: list[int], features: str = "features",
                label: str = "label", fold: str = "fold", folds: int = 3, seed: int = 42, **options) -> tuple[dict, list[tuple], object]:
    """(best parameters, [(numTrees, maxDepth, mean score over the folds)],
    the forest with the best ones fitted on all rows).  The score is accuracy
    (``kind`` classification) or R2; the first of equal scores wins."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    from tabsight.operators.tree_explain import _nodes
    classify = kind == "classification"
    est = RandomForestClassifier if classify else RandomForestRegressor
    args = dict(seed=seed, featuresCol=features, labelCol=label, **options)
    trees, depths = sorted(trees), sorted(depths)
    blocks, _ = _blocks(df, features, label, fold)
    blocks = blocks.persist()
    scores = {(n, d): [] for n in trees for d in depths}
    try:
        for k in range(folds):
            rest = df.where(F.col(fold) != k)
            if rest.isEmpty() or df.where(F.col(fold) == k).isEmpty():
                continue
            m = est(numTrees=trees[-1], maxDepth=depths[-1], **args).fit(rest)
            nodes = _nodes(m)
            packed = df.sparkSession.sparkContext.broadcast([_arrays(nodes[t], m.numClasses if classify else None) for t in sorted(nodes)])

            def one(x, y, f, k=k, packed=packed):
                here = f == k
                rows, want = x[here, 1:], y[here]
                sums, out = [0.0] * len(depths), []
                for t, tree in enumerate(packed.value, 1):
                    sums = [a + b for a, b in zip(sums, values_by_depth(tree, rows, depths))]
                    if t in trees:
                        for s in sums:
                            out.append((s.argmax(axis=1) == want).sum() if classify else ((s[:, 0] / t - want) ** 2).sum())
                return np.array([*out, len(want), want.sum(), (want * want).sum()], float)
            got = _summed(blocks, one)
            n, total = got[-3], got[-1] - got[-2] ** 2 / max(1.0, got[-3])
            for (at, v) in zip(((t, d) for t in trees for d in depths), got[:-3]):
                scores[at].append(v / n if classify else (1 - v / total if total > 0 else float("nan")))
    finally:
        blocks.unpersist()
    means = [(n, d, float(np.mean(v))) for (n, d), v in scores.items() if v]
    n, d, _ = max(means, key=lambda s: s[2])
    return {"numTrees": n, "maxDepth": d}, means, est(numTrees=n, maxDepth=d, **args).fit(df)
