"""Explainers, likelihood fits, boosting, tuning, k-means and silhouette
against brute force and closed forms."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import (arima_ml, boosting, cluster, kernel_explain, kmeans_batch, models, tree_explain, tuning)
from tabsight.operators.silhouette import silhouette


def shapley(value, d):
    """Attributions by their definition; ``value(set of features)``."""
    every = {frozenset(s): np.asarray(value(frozenset(s)), float) for r in range(d + 1) for s in itertools.combinations(range(d), r)}
    return np.array([sum(math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (every[s | {j}] - v)
                         for s, v in every.items() if j not in s) for j in range(d)])


# ------------------------------------------------------------------ tree explainer
@pytest.fixture(scope="module")
def mixed(spark):
    """Three numeric features and a categorical one, three classes."""
    from pyspark.ml.feature import VectorIndexer
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    x[:, 3] = rng.integers(0, 4, len(x))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float) + (x[:, 3] > 2)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, d double, label double")
    df = models.assemble(df, list("abcd"), "raw")
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=5).fit(df).transform(df)


def tree_value(nodes, at, x, known, classes):
    node = nodes[at]
    if node["leftChild"] < 0:
        stats = node["impurityStats"]
        return np.array([s / sum(stats) for s in stats]) if classes else np.array([node["prediction"]])
    split, left, right = node["split"], node["leftChild"], node["rightChild"]
    f, edge = split["featureIndex"], split["leftCategoriesOrThreshold"]
    if f in known:
        goes_left = x[f] <= edge[0] if split["numCategories"] < 0 else x[f] in edge
        return tree_value(nodes, left if goes_left else right, x, known, classes)

    def cover(i):
        return sum(nodes[i]["impurityStats"]) if classes else nodes[i]["impurityStats"][0]
    return (cover(left) * tree_value(nodes, left, x, known, classes)
            + cover(right) * tree_value(nodes, right, x, known, classes)) / cover(at)


@pytest.mark.parametrize("kind", ["forest_c", "tree_c", "forest_r", "boost_r", "boost_c"])
def test_tree_attributions_equal_all_subsets(mixed, kind):
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    est = {"forest_c": C.RandomForestClassifier(numTrees=3, maxDepth=5, seed=1), "tree_c": C.DecisionTreeClassifier(maxDepth=6),
           "forest_r": R.RandomForestRegressor(numTrees=3, maxDepth=5, seed=2), "boost_r": R.GBTRegressor(maxIter=3, maxDepth=3),
           "boost_c": C.GBTClassifier(maxIter=3, maxDepth=3)}[kind]
    train = mixed if kind != "boost_c" else mixed.withColumn("label", (F.col("label") > 0).cast("double"))
    m = est.fit(train)
    nodes = tree_explain._nodes(m)
    classes = kind in ("forest_c", "tree_c")
    weights = list(m.treeWeights) if "boost" in kind else [1 / len(nodes)] * len(nodes)
    rows = mixed.where("id < 3")
    got = {}
    for r in tree_explain.tree_attributions(m, rows, "id", "features", list("abcd")).collect():
        got[r["id"], "abcd".index(r["feature"]), r["class"] or 0] = r["attribution"]
    for r in rows.collect():
        x = r["features"].toArray()
        want = shapley(lambda s: sum(w * tree_value(nodes[t], 0, x, s, classes) for t, w in zip(sorted(nodes), weights)), 4)
        for (j, c), v in np.ndenumerate(want):
            assert got[r["id"], j, c] == pytest.approx(v, abs=1e-12)


def test_tree_attributions_add_up_and_paths_without_table(mixed, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    m = RandomForestClassifier(numTrees=5, maxDepth=7, seed=3).fit(mixed)
    trees, rows = tree_explain.pack_model(m), mixed.where("id < 40")
    x = np.array([r["features"].toArray() for r in rows.orderBy("id").collect()])
    x = np.vstack([x, [np.nan] * 4])
    by_table = sum(t.attributions(x) for t in trees)
    monkeypatch.setattr(tree_explain, "TABLE_FEATURES", 0)
    monkeypatch.setattr(tree_explain, "CELLS", 200)
    assert np.allclose(by_table, sum(t.attributions(x) for t in trees), atol=1e-13)
    p = np.array([r["probability"].toArray() for r in m.transform(rows).orderBy("id").collect()])
    assert np.allclose(by_table[:-1].sum(axis=1) + tree_explain.expectation(trees), p, atol=1e-12)
    with pytest.raises(TypeError):
        tree_explain.pack_model(models)


def test_attribution_ranking(spark):
    per = spark.createDataFrame([(1, "a", 0, 1.0), (2, "a", 0, -3.0), (1, "b", 0, 2.0), (2, "b", 0, 2.0), (1, "c", 0, 0.0),
                                 (2, "c", 0, 0.0)], "id int, feature string, class int, attribution double")
    got = [tuple(r) for r in tree_explain.attribution_ranking(per, 2).orderBy("rank").collect()]
    assert got == [(1, 0, "a", 2.0), (2, 0, "b", 2.0)]


# ---------------------------------------------------------------- kernel explainer
def test_kernel_attributions_exact_with_all_coalitions(spark):
    from pyspark.ml.classification import LogisticRegression
    rng = np.random.default_rng(0)
    names, x = list("abcdefgh"), rng.normal(size=(200, 8))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    df = models.assemble(spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                                               "id long, " + ", ".join(f"{c} double" for c in names) + ", label double"), names)
    m = LogisticRegression(maxIter=20).fit(df)
    w, b = m.coefficients.toArray(), m.intercept
    near = df.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(42)), "id").limit(10)
    ground = np.array([r["features"].toArray() for r in near.collect()])

    def value(row, s):
        z = ground.copy()
        z[:, list(s)] = row[list(s)]
        return (1 / (1 + np.exp(-(z @ w + b)))).mean()
    for n, tolerance in ((300, 1e-9), (60, 5e-3)):
        got = np.zeros((3, 8))
        for r in kernel_explain.kernel_attributions(m, df.where("id < 3"), df, "id", "features", names, n, 10,
                                                    output="probability").where("class = 1").collect():
            got[r["id"], names.index(r["feature"])] = r["attribution"]
        for i in range(3):
            assert np.allclose(got[i], shapley(lambda s: value(x[i], s), 8), atol=tolerance)
            assert got[i].sum() == pytest.approx(value(x[i], range(8)) - value(x[i], ()), abs=1e-9)


def test_coalitions():
    masks, weights = kernel_explain.coalitions(4, 50)
    assert len(masks) == 14 and len({tuple(m) for m in masks.tolist()}) == 14 and (weights > 0).all()
    masks, _ = kernel_explain.coalitions(20, 50)
    assert 45 <= len(masks) <= 50 and sorted(masks.sum(axis=1).tolist())[:20] == [1] * 20
    assert kernel_explain.solution(*kernel_explain.coalitions(1, 50)).tolist() == [[1.0]]


# ---------------------------------------------------------------------- ARIMA
def autocovariance(ar, ma, n, terms=3000):
    psi = np.zeros(terms)
    for j in range(terms):
        psi[j] = (1.0 if j == 0 else ma[j - 1] if j - 1 < len(ma) else 0.0) + sum(
            a * psi[j - 1 - i] for i, a in enumerate(ar) if j - 1 - i >= 0)
    return np.array([psi[:terms - k] @ psi[k:] for k in range(n)])


@pytest.mark.parametrize("p, q", [(2, 2), (1, 0), (0, 1), (0, 0), (3, 1), (1, 3)])
def test_likelihood_equals_the_normal_density(p, q):
    rng = np.random.default_rng(p * 10 + q)
    for n in (1, 7, 40):
        x, w = rng.normal(size=p + q) * 0.7, rng.normal(size=n) * 2
        ar, ma = arima_ml.split_parameters(x, p)
        cov = autocovariance(ar, ma, n)[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
        s2 = w @ np.linalg.solve(cov, w) / n
        want = -0.5 * (n * np.log(2 * np.pi * s2) + np.linalg.slogdet(cov)[1] + n)
        whole = arima_ml.element(w, 0, x[None], p, q)
        assert whole.log_likelihood()[0] == pytest.approx(want, rel=1e-9)
        for cut in range(1, n, 5):
            both = arima_ml.element(w[:cut], 0, x[None], p, q).then(arima_ml.element(w[cut:], cut, x[None], p, q))
            assert np.allclose(both.flat(), whole.flat(), atol=1e-9)
        assert np.allclose(arima_ml.Element.from_flat(whole.flat(), max(p, q + 1)).flat(), whole.flat())


def simulated(n, seed, ar=(0.5, -0.3), ma=(0.4, 0.25)):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(2, n + 200):
        w[t] = ar[0] * w[t - 1] + ar[1] * w[t - 2] + e[t] + ma[0] * e[t - 1] + ma[1] * e[t - 2]
    return w[200:]


def test_fit_recovers_simulated_terms():
    fit = arima_ml.fit_series(simulated(20_000, 1), 2, 2)
    assert np.allclose(fit["ar"], (0.5, -0.3), atol=0.06) and np.allclose(fit["ma"], (0.4, 0.25), atol=0.06)
    assert fit["sigma2"] == pytest.approx(1, abs=0.03)
    for seed in range(4):
        for p, q in ((2, 2), (0, 1), (1, 1)):
            fit = arima_ml.fit_series(simulated(60 + 40 * seed, seed), p, q)
            assert fit["log_likelihood"] >= fit["start_log_likelihood"] - 1e-9


def test_parameters_round_trip():
    rng = np.random.default_rng(5)
    for n in range(5):
        x = rng.normal(size=n)
        assert np.allclose(arima_ml.unbounded(arima_ml.coefficients(x)), x)


def test_blocks_equal_one_block(spark):
    rows = [(k, t, float(v)) for k, n in (("a", 900), ("b", 40), (None, 500), ("short", 1)) for t, v in
            enumerate(np.cumsum(simulated(n, n)))]
    rows += [("a", 5000, None), ("a", None, 3.0), ("b", 99, float("nan"))]
    df = spark.createDataFrame(rows, "key string, t long, v double").repartition(5)
    whole = {r["key"]: r for r in arima_ml.arima_fit(df, ["key"], "t", "v").collect()}
    cut = {r["key"]: r for r in arima_ml.arima_fit(df, ["key"], "t", "v", block_rows=150).collect()}
    assert set(whole) == set(cut) == {"a", "b", None}
    assert {k: r["n_diff"] for k, r in cut.items()} == {"a": 899, "b": 39, None: 499}
    for k in whole:
        assert cut[k]["log_likelihood"] == pytest.approx(whole[k]["log_likelihood"], abs=1e-3)
        assert np.allclose(cut[k]["ar"] + cut[k]["ma"], whole[k]["ar"] + whole[k]["ma"], atol=0.05)
    fc = arima_ml.arima_ml_forecast(df, ["key"], "t", "v", block_steps=30).where("key = 'a'").orderBy("step").collect()
    assert len(fc) == 180 and [r["step"] for r in fc] == list(range(1, 181))
    fit = {r["key"]: r for r in arima_ml.arima_fit(df, ["key"], "t", "v", frac=0.8).collect()}["a"]
    state, level = np.array(fit["state"]), float(np.cumsum(simulated(900, 900))[719])
    for r in fc[:100]:
        step = state[0]
        state = np.append(state[1:], 0.0)
        state[:2] += np.array(fit["ar"]) * step
        level += step
        assert r["forecast"] == pytest.approx(level, abs=1e-8)


def test_forecast_of_no_and_of_tiny_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("b", 2, 2.0), ("b", 3, 4.0)], "key string, t long, v double")
    got = arima_ml.arima_ml_forecast(df, ["key"], "t", "v", frac=0.7).collect()
    assert {(r["key"], r["forecast"] is None) for r in got} == {("a", True), ("b", False)}
    assert arima_ml.arima_ml_forecast(df.where("false"), ["key"], "t", "v").count() == 0


# ------------------------------------------------------------------- boosting
def plain_boosting(x, y, edges, rounds, depth, step, ridge, classes, bins):
    b = boosting.binned(x, edges)
    margin = np.tile(np.log([np.mean(y == k) for k in range(classes)]), (len(x), 1))
    for _ in range(rounds):
        p, new = boosting.softmax(margin), np.zeros_like(margin)
        for k in range(classes):
            g, h = (y == k) - p[:, k], p[:, k] * (1 - p[:, k])

            def grow(rows, level):
                total, best, gain = g[rows].sum() ** 2 / (h[rows].sum() + ridge), None, 1e-10
                for f, cut in itertools.product(range(x.shape[1]), range(bins)) if level < depth else ():
                    low, high = rows[b[rows, f] <= cut], rows[b[rows, f] > cut]
                    if len(low) and len(high):
                        s = sum(g[r].sum() ** 2 / (h[r].sum() + ridge) for r in (low, high)) - total
                        if s > gain + 1e-12:
                            best, gain = (low, high), s
                if best is None:
                    new[rows, k] = step * (classes - 1) / classes * g[rows].sum() / (h[rows].sum() + ridge)
                else:
                    for r in best:
                        grow(r, level + 1)
            grow(np.arange(len(x)), 0)
        margin += new
    return margin


def test_softmax_boosting_equals_plain_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 3)), 2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.2)
    df = models.assemble(spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                                               "id long, a double, b double, c double, label double").repartition(3), list("abc"))
    m = boosting.SoftmaxBoosting(rounds=5, depth=3, bins=8, checkpoint_rounds=2).fit(df)
    want = plain_boosting(x, y, m.edges, 5, 3, 0.1, 1.0, 3, 8)
    assert np.allclose(m.margins(boosting.binned(x, m.edges)), want, atol=1e-12)
    assert len(m.loss) == 6 and all(b < a for a, b in zip(m.loss, m.loss[1:]))
    p = boosting.softmax(want)
    assert m.loss[-1] == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean())
    for r in m.transform(df).collect():
        assert np.allclose(r["probability"].toArray(), p[r["id"]]) and r["prediction"] == p[r["id"]].argmax()
    base = np.array(tree_explain.expectation(m.packed())) + m.prior
    got = np.tile(base, (2, 1))
    for r in tree_explain.tree_attributions(m.packed(), df.where("id < 2"), "id", "features", list("abc")).collect():
        got[r["id"], r["class"]] += r["attribution"]
    assert np.allclose(got, want[:2], atol=1e-9)


def test_softmax_boosting_edge_cases(spark):
    df = spark.createDataFrame([(float(i % 3), None if i == 7 else float("nan") if i % 5 == 0 else float(i), 1.0) for i in range(60)],
                               "label double, a double, b double").na.fill(0.0, ["a"])
    m = boosting.SoftmaxBoosting(rounds=3, bins=4, n_classes=4).fit(models.assemble(df, ["a", "b"]))
    p = [r["probability"].toArray() for r in m.transform(models.assemble(df, ["a", "b"])).collect()]
    assert all(len(v) == 4 and v[3] < 1e-3 for v in p)
    with pytest.raises(ValueError):
        boosting.SoftmaxBoosting().fit(models.assemble(df.where("false"), ["a", "b"]))
    with pytest.raises(ValueError):
        boosting.SoftmaxBoosting(bins=1000)


# --------------------------------------------------------------------- tuning
@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    yb = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) > 0).astype(float)
    rows = [(i, *map(float, r), float(b), float(b + (r[2] > 0.7)), float(3 * r[0] - r[1] + 10 + e)) for i, (r, b, e) in
            enumerate(zip(x, yb, rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, yb double, ym double, yr double").repartition(3)
    return tuning.fold_of(models.assemble(df, list("abc")), "id", 3).persist()


@pytest.mark.parametrize("label", ["yb", "ym"])
def test_logistic_tuning_equals_single_fits(folded, label):
    from pyspark.ml.classification import LogisticRegression
    best, scores, w, passes = tuning.tune_logistic(folded, [0.1, 10.0], label=label)

    def fit(rows, c):
        return LogisticRegression(labelCol=label, regParam=1 / (c * rows.count()), standardization=False, maxIter=500, tol=1e-10).fit(rows)
    for c, score in scores:
        got = []
        for k in range(3):
            p = fit(folded.where(F.col("fold") != k), c).transform(folded.where(F.col("fold") == k))
            got.append(p.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0])
        assert score == pytest.approx(np.mean(got), abs=1e-12)
    m = fit(folded, best)
    assert np.allclose(w[1:].T, m.coefficientMatrix.toArray(), atol=1e-3)
    assert best == max(scores, key=lambda s: s[1])[0]
    assert passes <= tuning.tune_logistic(folded, [0.1, 0.3, 1.0, 3.0, 10.0], label=label)[3] + 3


def test_ridge_tuning_equals_single_fits(folded):
    alphas = [0.1, 1.0, 100.0]
    best, scores, w = tuning.tune_ridge(folded, alphas, label="yr")
    data = folded.select("id", "features", "yr", "fold").orderBy("id").collect()
    x, y, fold = np.array([r["features"].toArray() for r in data]), np.array([r["yr"] for r in data]), np.array([r["fold"] for r in data])

    def fit(at, alpha):
        mx, my = x[at].mean(0), y[at].mean()
        v = np.linalg.solve((x[at] - mx).T @ (x[at] - mx) + alpha * np.eye(3), (x[at] - mx).T @ (y[at] - my))
        return np.append(my - mx @ v, v)
    for alpha, score in scores:
        r2 = []
        for k in range(3):
            v, here = fit(fold != k, alpha), fold == k
            r2.append(1 - ((y[here] - v[0] - x[here] @ v[1:]) ** 2).sum() / ((y[here] - y[here].mean()) ** 2).sum())
        assert score == pytest.approx(np.mean(r2), abs=1e-9)
    assert best == max(scores, key=lambda s: s[1])[0] and np.allclose(w, fit(fold >= 0, best))


@pytest.mark.parametrize("kind, label", [("classification", "ym"), ("regression", "yr")])
def test_forest_tuning_scores_every_pair_from_one_fit(folded, kind, label):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    params, scores, m = tuning.tune_forest(folded, kind, [3, 6], [2, 8], label=label)
    assert len(scores) == 4 and params == dict(zip(("numTrees", "maxDepth"), max(scores, key=lambda s: s[2])[:2]))
    assert m.getNumTrees == params["numTrees"]
    # the largest pair is the fitted forest itself; a forest of one level more is not better than its own cut
    est = RandomForestClassifier if kind == "classification" else RandomForestRegressor
    want = []
    for k in range(3):
        p = est(numTrees=6, maxDepth=8, seed=42, labelCol=label).fit(folded.where(F.col("fold") != k)).transform(folded.where(F.col("fold") == k))
        y, g = (np.array([r[c] for r in p.collect()]) for c in (label, "prediction"))
        want.append((y == g).mean() if kind == "classification" else 1 - ((y - g) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert dict(((n, d), s) for n, d, s in scores)[6, 8] == pytest.approx(np.mean(want), abs=1e-9)


def test_values_by_depth_equal_a_shallower_tree(folded):
    from pyspark.ml.regression import DecisionTreeRegressor
    x = np.array([r["features"].toArray() for r in folded.orderBy("id").collect()])
    deep = tuning._arrays(tree_explain._nodes(DecisionTreeRegressor(maxDepth=7, labelCol="yr").fit(folded))[0], None)
    for depth, got in zip((0, 2, 4), tuning.values_by_depth(deep, x, [0, 2, 4])):
        p = DecisionTreeRegressor(maxDepth=depth, labelCol="yr").fit(folded).transform(folded.orderBy("id"))
        assert np.allclose(got[:, 0], [r["prediction"] for r in p.collect()])


# -------------------------------------------------------------------- k-means
def test_batched_kmeans_inertia_and_sharing(spark):
    from pyspark.ml.clustering import KMeans
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6)) + 100 + 2 * rng.integers(0, 4, (600, 1))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)
    runs = kmeans_batch.batched_kmeans(df, "v", [2, 3, 7], starts=3, checkpoint_passes=3)
    assert [r.k for r in runs] == [2, 2, 2, 3, 3, 3, 7, 7, 7]
    vec = cluster.to_vector(df, "v", "features")
    for k, more in ((2, 1e-3), (3, 1e-3), (7, 0.02)):  # four groups: seven clusters have many near-best solutions
        theirs = min(KMeans(k=k, seed=s).fit(vec).summary.trainingCost for s in range(3))
        assert min(r.inertia for r in runs if r.k == k) <= theirs * (1 + more)
    for r in runs:
        d = ((x[:, None] - r.centres[None]) ** 2).sum(2)
        assert r.inertia == pytest.approx(d.min(1).sum(), rel=1e-3) and r.inertia >= d.min(1).sum() - 1e-6
    m, out = cluster.kmeans(df, "v", 3)
    rows = {r["id"]: r["cluster"] for r in out.collect()}
    assert all(((x[i] - m.centres) ** 2).sum(1).argmin() == c for i, c in rows.items())


def test_margins_skip_rows_and_change_nothing():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(200, 3)) + 4])
    run = kmeans_batch.Run(5, x[:5].copy())
    batch = kmeans_batch._state(x, np.zeros((400, 1), np.uint8), np.full((400, 1), -1.0, np.float32), np.zeros((5, 4)), np.zeros(0))
    compared = []
    for _ in range(12):
        (batch,) = list(kmeans_batch._advance([run], [0], 3)(iter([batch])))
        total = np.frombuffer(batch.column("sums")[0].as_py(), float)
        sums, n = total[:20].reshape(5, 4), total[20]
        own = kmeans_batch._nearest(x, run.centres)[0]
        assert np.array_equal(np.frombuffer(batch.column("cluster")[0].as_py(), np.uint8), own)
        assert np.allclose(sums, kmeans_batch._sums(x, own, 5), atol=1e-8)
        compared.append(n)
        new = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), run.centres)
        run.moved, run.centres = np.sqrt(((new - run.centres) ** 2).sum(1)), new
    assert compared[0] == 400 and compared[-1] < 300


def test_kmeans_of_few_and_equal_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    runs = kmeans_batch.batched_kmeans(df, "v", [2], 2)
    assert all(r.inertia == pytest.approx(0) for r in runs)
    assert kmeans_batch.batched_kmeans(df.where("false"), "v", [2], 2) == []


# ----------------------------------------------------------------- silhouette
@pytest.mark.parametrize("offset, apart", [(0, 0.5), (1000, 3), (0, 20)])
def test_euclidean_silhouette_equals_all_pairs(spark, offset, apart):
    rng = np.random.default_rng(0)
    y = np.concatenate([np.zeros(150, int), np.ones(60, int), [2], rng.integers(3, 9, 90)])
    x = (rng.normal(size=(9, 5)) * apart)[y] + rng.normal(size=(len(y), 5)) + offset
    x[5] = x[7]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i, own in enumerate(y):
        n = (y == own).sum()
        a, b = d[i, y == own].sum() / max(n - 1, 1), min(d[i, y == c].mean() for c in set(y.tolist()) - {own})
        want.append((b - a) / max(a, b) if n > 1 else 0.0)
    df = spark.createDataFrame([(x[i].tolist(), int(c)) for i, c in enumerate(y)], "v array<double>, lab int")
    for tile in (8192, 20):
        got = silhouette(df, "v", "lab", tile_rows=tile).first()
        assert got["silhouette"] == pytest.approx(np.mean(want), abs=1e-9) and got["n_clusters"] == 9
    points = sorted((r["lab"], r["s"]) for r in silhouette(df, "v", "lab", by_point=True).collect())
    assert np.allclose([s for _, s in points], [s for _, s in sorted(zip(y.tolist(), want))], atol=1e-9)
    assert silhouette(df.where("lab IN (0, 2)"), "v", "lab", noise=2).first()["silhouette"] == -1.0


# --------------------------------------------------------------------- DBSCAN
@pytest.mark.parametrize("d, eps", [(8, 1.2), (64, 6.0)])
def test_dbscan_in_many_dimensions_equals_brute_force(spark, d, eps, monkeypatch):
    from tabsight.operators import dbscan as D
    from tests.test_operators import _brute_dbscan
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(6, d)) * 4
    x = np.concatenate([c + rng.normal(size=(40, d)) * 0.5 for c in centres] + [rng.uniform(-8, 8, (40, d))])
    x[3] = x[4]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)
    monkeypatch.setattr(D, "PART_POINTS", 30)
    got = [r["cluster"] for r in D.dbscan(df, "id", "v", eps, 5).orderBy("id").collect()]
    assert got == _brute_dbscan(x, eps, 5).tolist() and len(set(got)) >= 6
    work = D.compared_pairs(df, "id", "v", eps).first()
    assert work["n"] == len(x) and work["share"] < 0.5


# ------------------------------------------------------------------------ SVD
def angle(a, b):
    """Sine of the largest angle between two column spaces."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


@pytest.mark.parametrize("kind", ["dense", "sparse", "mixed"])
def test_randomised_svd_equals_exact_factors(spark, kind):
    from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
    from pyspark.sql import types as T
    from tabsight.operators.svd import project, randomized_svd
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 40)) * (0.85 ** np.arange(40)) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    if kind != "dense":
        x = np.where(rng.random(x.shape) < 0.3, x, 0.0)
        x[5] = 0.0

    def vector(i, row):
        if kind == "dense" or kind == "mixed" and i % 2:
            return DenseVector(row)
        at = np.flatnonzero(row)
        return SparseVector(40, at, row[at])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", VectorUDT())])
    df = spark.createDataFrame([(i, vector(i, r)) for i, r in enumerate(x)] + [(-1, None)], schema).repartition(20)
    got = randomized_svd(df, "v", 3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(got.s, s[:3], rtol=1e-6) and angle(got.v, vt[:3].T) < 1e-3
    assert got.variance == pytest.approx(x.var(axis=0, ddof=1).sum())
    rows = {r["id"]: r for r in project(df, "v", got.v, ["p", "q", "r"]).collect()}
    assert rows[-1]["p"] is None
    assert np.allclose([[rows[i][c] for c in "pqr"] for i in range(200)], x @ got.v)


def test_svd_of_few_rows_and_columns(spark):
    from tabsight.operators.svd import randomized_svd
    df = cluster.to_vector(spark.createDataFrame([([1.0, 2.0],), ([2.0, 4.0],)], "v array<double>"), "v", "f")
    got = randomized_svd(df, "f", 5)
    assert got.s[0] == pytest.approx(5.0) and abs(got.s[1:]).max(initial=0) < 1e-9
    with pytest.raises(ValueError):
        randomized_svd(df.where("false"), "f", 2)


# ------------------------------------------------------ approximate neighbours
def test_cheapest_flips_equal_all_subsets():
    from tabsight.operators.ann import cheapest_flips
    rng = np.random.default_rng(0)
    for _ in range(30):
        cost = rng.random(6)
        every = sorted(range(64), key=lambda m: sum(c for i, c in enumerate(cost) if m >> i & 1))
        got = cheapest_flips(cost, 20)
        assert got[0] == 0 and np.allclose([sum(c for i, c in enumerate(cost) if m >> i & 1) for m in got],
                                           [sum(c for i, c in enumerate(cost) if m >> i & 1) for m in every[:20]])
        assert len(set(cheapest_flips(cost, 64))) == 64


def test_ann_recall_and_candidates(spark):
    from tabsight.operators import ann
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 2
    x = centres[rng.integers(0, 40, 2200)] + rng.normal(size=(2200, 16))
    x[:300] = x[0]  # one bucket holds many equal rows
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(4)
    train, test = df.where("id % 10 > 0"), df.where("id % 10 = 0")
    got = ann.recall(train, test, "id", "v", 5, max_group=100).first()
    assert got["n_queries"] == 220 and got["recall"] >= 0.9
    met = ann.candidates(train, test, "id", "v", tables=4, probes=4).agg(F.avg("candidates"), F.count("*")).first()
    assert met[1] == 220 and 0 < met[0] < 0.8 * 1980
    nb = ann.ann_neighbours(train, test, "id", "v", 3).collect()
    assert all(r["dist"] == pytest.approx(np.linalg.norm(x[r["id"]] - x[r["neighbour_id"]]), abs=1e-9) for r in nb)
    assert ann.ann_neighbours(train.where("false"), test, "id", "v", 3).count() == 0


# -------------------------------------------------------------------- density
def test_kernel_sums_equal_direct_sums(spark):
    from tabsight.operators import density
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.normal(size=900), [25.0, -14.0], np.full(50, 3.25)]) + 1e4
    b = rng.exponential(size=len(a)) * 1e-3
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)] + [(None, float("nan"))], "a double, b double").repartition(3)

    def direct(x, points):
        h = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min(), x.max(), points)
        return np.exp(-0.5 * ((grid[:, None] - x[None]) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    got = [r["density"] for r in density.kde(df, "a", 120, digits=None).orderBy("point").collect()]
    assert np.allclose(got, direct(a, 120), rtol=1e-9, atol=1e-13)
    both = density.violin_density(df, ["a", "b"], 50, digits=12).orderBy("column", "point").collect()
    assert np.allclose([r["density"] for r in both if r["column"] == "b"], direct(b, 50), rtol=1e-9, atol=1e-9)


# ------------------------------------------------------------ mergeable profile
def test_merged_sketches_equal_one_pass(spark):
    from tabsight.operators import sketches as S
    rng = np.random.default_rng(3)
    rows = [(i % 5, float(v) + 1e6, int(i % 700), None if i % 11 else f"t{i % 90}", float("nan") if i % 13 == 0 else float(i % 4), None)
            for i, v in enumerate(rng.exponential(size=6000))]
    df = spark.createDataFrame(rows, "day int, a double, b int, c string, d double, e double").repartition(6)
    parts = S.sketch_table(df, part=["day"])
    assert parts.count() == 25
    merged = {r["column"]: r for r in S.profile_of(S.merge_sketches(parts)).collect()}
    whole = {r["column"]: r for r in S.profile_of(S.sketch_table(df.drop("day"))).collect()}
    for c in "abcde":
        m, w = merged[c], whole[c]
        assert (m["n_rows"], m["n_missing"], m["lo"], m["hi"]) == (w["n_rows"], w["n_missing"], w["lo"], w["hi"])
        assert m["n_distinct"] == pytest.approx(w["n_distinct"], rel=0.01)  # a merged sketch uses another estimator
        for k in ("mean", "std"):
            assert m[k] == w[k] or m[k] == pytest.approx(w[k], rel=1e-9)
    assert merged["e"]["quantiles"] is None and merged["e"]["n_distinct"] == 0 and merged["c"]["mean"] is None
    # two loads, then a third: the old sketches are kept
    old = S.merge_sketches(parts.where("day < 4"))
    both = S.profile_of(S.merge_sketches(old.unionByName(parts.where("day = 4").drop("day"))))
    errors = {r["column"]: r for r in S.measured_errors(df, both).collect()}
    assert all(r["distinct_error"] <= 0.05 and (r["rank_error"] or 0) <= 0.02 for r in errors.values())
    a = {r["column"]: r for r in both.collect()}["a"]
    assert a["std"] == pytest.approx(float(np.std([r[1] for r in rows], ddof=1)), rel=1e-9)
    per_day = S.profile_of(S.merge_sketches(parts, ["day"]), by=["day"])
    assert per_day.count() == 25 and per_day.where("column = 'a'").agg(F.sum("n_rows")).first()[0] == 6000


# ------------------------------------------------------------------ adapters
def test_optional_boosters_are_built_when_installed(monkeypatch):
    import importlib
    import importlib.util
    import types

    class Stub:
        def __init__(self, **kw):
            self.kw = kw
    modules = {"xgboost.spark": ("SparkXGBClassifier", "SparkXGBRegressor"), "synapse.ml.lightgbm": ("LightGBMClassifier", "LightGBMRegressor"),
               "catboost_spark": ("CatBoostClassifier", "CatBoostRegressor")}
    made = {name: types.SimpleNamespace(**{c: type(c, (Stub,), {}) for c in classes}) for name, classes in modules.items()}
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: name)
    monkeypatch.setattr(importlib, "import_module", lambda name: made[name])
    for at, kind in enumerate(("classification", "regression")):
        got = models.optional_boosters(kind, "y", "x")
        assert {k: type(v).__name__ for k, v in got.items()} == {
            "xgboost": modules["xgboost.spark"][at], "lightgbm": modules["synapse.ml.lightgbm"][at], "catboost": modules["catboost_spark"][at]}
        assert all(50 in v.kw.values() and 42 in v.kw.values() and "y" in v.kw.values() and "x" in v.kw.values() for v in got.values())


def test_multiclass_catalogue_trains_one_boosting_model(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0)
    df = models.assemble(spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                                               "id long, a double, b double, label double"), ["a", "b"])
    board, fitted, _ = models.train_all(df.where("id % 4 > 0"), df.where("id % 4 = 0"), "classification", "id",
                                        scaled="features", models=["gradient_boosting", "decision_tree"])
    assert isinstance(fitted["gradient_boosting"], boosting.SoftmaxModel)
    scores = {r["model"]: (r["accuracy"], r["error"]) for r in board.collect()}
    assert scores["gradient_boosting"][0] > 0.85 and scores["gradient_boosting"][1] is None


# ------------------------------------------------------------ widths per key
def test_rolling_width_of_each_key(spark):
    from tabsight.operators.series import rolling_by_key
    rng = np.random.default_rng(6)
    rows = [(k, t, None if (k, t) == ("a", 40) else float(v)) for k, n in (("a", 300), ("b", 40), (None, 5), ("d", 1))
            for t, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "k string, t int, v double").withColumn("id", F.col("t"))
    got = {(r["k"], r["t"]): r for r in rolling_by_key(df, ["k"], "t", "v", "id", digits=None).collect()}
    assert len(got) == len(rows)
    series = {}
    for k, t, v in rows:
        series.setdefault(k, []).append(v)
    for k, values in series.items():
        w = max(2, min(30, len(values) // 8))
        for t in range(len(values)):
            r, part = got[k, t], values[max(0, t - w + 1):t + 1]
            assert r["w"] == w
            if len(part) < w or None in part:
                assert r["ma"] is None and r["std"] is None
            else:
                assert r["ma"] == pytest.approx(np.mean(part)) and r["std"] == pytest.approx(np.std(part, ddof=1))
