"""What a task, the driver or a pass handles must not grow faster than the table."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


def test_dbscan_compares_only_what_sure_links_leave_apart(spark, monkeypatch):
    from tabsight.operators import dbscan as D
    seen, real = [], D._touching

    def counted(pts, pairs, *rest):
        seen.append(pairs.count())
        return real(pts, pairs, *rest)
    monkeypatch.setattr(D, "_touching", counted)
    rows = [(i * 40 + j, [i * 0.06, j * 0.06]) for i in range(40) for j in range(40)]
    got = D.dbscan(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.5, 5)
    assert {r["cluster"] for r in got.collect()} == {0}
    assert seen == [0]


def test_dbscan_links_dense_clusters_through_one_near_pair(spark):
    from tabsight.operators.dbscan import dbscan
    rng = np.random.default_rng(3)
    for gap, want in ((0.499, {0}), (0.501, {0, 1})):
        left = np.vstack([rng.uniform([-1, 0], [0, 0.6], (300, 2)), [[0, 0.3]]])
        right = np.vstack([rng.uniform([gap, 0], [gap + 1, 0.6], (300, 2)), [[gap, 0.3]]])
        left[:-1, 0] -= 0.2
        right[:-1, 0] += 0.2
        v = np.vstack([left, right])
        rows = [(i, x.tolist()) for i, x in enumerate(v)]
        got = dbscan(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.5, 5)
        assert {r["cluster"] for r in got.collect()} == want


def test_knn_handles_a_bounded_block_of_queries_and_pivots(spark):
    from tabsight.operators import knn
    rng = np.random.default_rng(1)
    pivots = rng.normal(size=(3000, 3))
    vecs = list(rng.normal(size=(1500, 3)))
    batch = pd.DataFrame({"t_id": range(1500), "t_vec": vecs})
    out = list(knn._assign(pivots, np.zeros(3))(iter([batch])))
    assert sum(map(len, out)) == 1500 and max(map(len, out)) * 3000 <= knn.BLOCK


def test_knn_searches_few_cells(spark):
    from tabsight.operators import knn
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), i % 5 == 0) for i, v in enumerate(rng.normal(size=(1500, 3)))]
    df = spark.createDataFrame(rows, "id long, v array<double>, test boolean")
    train, test = df.where("NOT test"), df.where("test")
    got = {}
    for r in knn.knn_neighbours(train, test, "id", "v", 4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour_id"]
    tr = [(i, np.array(v)) for i, v, t in rows if not t]
    for i, v, t in rows:
        if t:
            d = sorted((float(np.sqrt(((np.array(v) - x) ** 2).sum())), j) for j, x in tr)
            assert [got[i][k] for k in range(1, 5)] == [j for _, j in d[:4]]
    # the plane half-way between pivots keeps out cells that the radius does not
    pivots = np.array([[0.0, 0.0], [1.0, 0.0], [4.0, 0.0]])
    batch = pd.DataFrame({"q_id": [1], "q_vec": [np.array([0.1, 0.0])], "cell": [0], "r": [0.2]})
    out = next(knn._candidates(pivots, np.array([3.0, 3.0, 5.0]), np.zeros(2))(iter([batch])))
    assert out["cells"].iloc[0].tolist() == []
    batch["r"] = 0.4
    out = next(knn._candidates(pivots, np.array([3.0, 3.0, 5.0]), np.zeros(2))(iter([batch])))
    assert out["cells"].iloc[0].tolist() == [1]


def test_tree_explainer_returns_bounded_slices(monkeypatch):
    from tabsight.operators import tree_explain as T
    tree = T.PackedTree(np.array([[0], [0]]), np.array([[-np.inf], [0.5]]), np.array([[0.5], [np.inf]]),
                        np.full((2, 1), -1), np.zeros((1, 1), bool), np.array([[0.5], [0.5]]), np.array([[0.0], [1.0]]))
    monkeypatch.setattr(T, "CELLS", 8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([[i / 10, 0.0] for i in range(10)])], names=["id", "x"])
    out = list(T._worker(SimpleNamespace(value=[tree]), 2)(iter([batch])))
    assert [b.num_rows for b in out] == [4, 4, 2]
    a = np.concatenate([b.column(2).flatten().to_numpy() for b in out]).reshape(10, 2)
    assert a[:, 0].tolist() == [-0.5] * 6 + [0.5] * 4 and not a[:, 1].any()


def test_driver_gets_one_array(spark, monkeypatch):
    from tabsight.operators.boosting import tree_sum
    parts = spark.createDataFrame([(np.array([1.0, i]).tobytes(),) for i in range(4)], "x binary").repartition(4)
    sizes, real = [], type(parts).collect

    def collect(self):
        got = real(self)
        sizes.append(len(got))
        return got
    monkeypatch.setattr(type(parts), "collect", collect)
    assert tree_sum(parts, 1).tolist() == [4.0, 6.0]
    assert sizes == [1]


def test_silhouette_sums_in_blocks(monkeypatch):
    from tabsight.operators import silhouette as S
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(70, 6)), rng.normal(size=(2500, 6))
    y[:70] = x
    y[100] = x[3] + 1e-9
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)).sum(axis=1)
    sizes, real = [], S._distances

    def noted(*a):
        d = real(*a)
        sizes.append(d.size)
        return d
    monkeypatch.setattr(S, "_distances", noted)
    assert np.allclose(S.distance_sums(x, y), want, rtol=1e-12)
    assert max(sizes) <= S.BLOCK and len(sizes) > 1


def test_prepared_rows_have_fitted_numbers_in_their_plan(spark):
    from tabsight.plans.preprocess import prepare
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 101), float(i)) for i in range(200)],
                               "id long, a double, b double, y double")
    pr = prepare(df, "y", "id")
    assert "Aggregate" not in pr.train._jdf.queryExecution().optimizedPlan().toString()


def test_selection_forest_reads_bounded_partitions(spark):
    from tabsight.session import dealt
    df = spark.range(0, 1000, 1, 2).select(F.col("id").cast("double").alias("x"))
    assert dealt(df, 100).rdd.getNumPartitions() == 10
    assert dealt(df, 500).rdd.getNumPartitions() == 2
    assert dealt(df, 100).agg(F.sum("x")).first()[0] == 999 * 500


def test_classification_input_is_read_once(spark, tmp_path):
    from tabsight.plans import catalog_models as C
    docs = [(i, f"w{i % 3} and more words " * (1 + i % 4), "en" if i % 2 else "de", "web", 20 + i) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    plan = C._prep_cls(spark, str(tmp_path)).train._jdf.queryExecution().optimizedPlan().toString()
    assert "n_tokens" in plan and "text" not in plan


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_forest_of_many_rows_is_grown_on_their_cells(spark, monkeypatch, kind):
    from tabsight.operators import forest, models
    rng = np.random.default_rng(3)
    n = 6000
    a, b, c = rng.integers(0, 5, n).astype(float), rng.normal(size=n), rng.integers(0, 3, n).astype(float)
    y = 3 * a + 4 * (b > 0.3) + rng.normal(size=n)
    if kind == "classification":
        y = (y > 7).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, label double").repartition(3)
    df = models.assemble(df, ["a", "b", "c"])
    want = forest.fit_forest(df, kind, 10, 5).featureImportances.toArray()
    fits, real = [], forest.bootstrapped_cells

    def noted(*args):
        fits.append(real(*args).persist())
        return fits[-1]
    monkeypatch.setattr(forest, "bootstrapped_cells", noted)
    monkeypatch.setattr(forest, "DIRECT", n - 1)
    m = forest.fit_forest(df, kind, 10, 5)
    assert np.abs(m.featureImportances.toArray() - want).max() < 0.08 and m.featureImportances.toArray().sum() == pytest.approx(1)
    assert [len(e) for e in m.edges] == [4, 31, 2]
    cells = [(tuple(r["x"]), np.array(r["w"]), np.array(r["m"])) for r in fits[0].collect()]
    assert len(cells) < n / 4 and len(m.trees) == 10
    w, total = (sum(v) for v in zip(*((w, w * t) for _, w, t in cells)))
    assert (np.abs(w - n) < 5 * np.sqrt(n)).all() and len(set(w)) > 1  # a Poisson(1) weight for every row and tree
    assert np.allclose(total / w, y.mean(), atol=0.05 * np.abs(y).max())


def test_forest_on_cells_splits_as_one_on_rows(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor

    from tabsight.operators import forest, models
    rows = [(float(i % 4), float(i // 7 % 9), float((i * 37) % 11 + 5 * (i % 4))) for i in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    arrays = df.select(F.array("a", "b").alias("x"), F.col("label").alias("y"))
    monkeypatch.setattr(np.random, "default_rng", lambda *a: type("Once", (), {"poisson": lambda s, n, size: np.ones(size)})())
    run = forest._drawn(2, 0, False)
    binned = next(forest._binned(forest.cut_points(arrays, 2))(iter(arrays.toArrow().combine_chunks().to_batches())))
    order = sorted(range(900), key=lambda i: binned.column(0)[i].as_py())
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda s: 0})())
    cells = [r for b in run(iter([binned.take(order)])) for r in b.to_pylist()]
    assert len(cells) == 36 and sum(r["w"][0] for r in cells) == 900
    few = spark.createDataFrame([(r["x"], float(r["w"][1]), r["m"][1]) for r in cells], "x array<double>, w double, label double")
    few = few.select(array_to_vector("x").alias("features"), "w", "label")
    on_cells = DecisionTreeRegressor(maxDepth=4, weightCol="w").fit(few)
    on_rows = DecisionTreeRegressor(maxDepth=4).fit(models.assemble(df, ["a", "b"]))
    assert np.allclose(on_cells.featureImportances.toArray(), on_rows.featureImportances.toArray()) and on_cells.numNodes == on_rows.numNodes
