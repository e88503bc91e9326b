"""Tests of the findings of round 4."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F


def _tables(spark, path, n=400):
    """lineitem and part of ``n`` and 20 rows; the last part key has no part."""
    rows = [(i, i % 21, i % 7, i % 4, float(1 + i % 50), 100.0 + (i * 37 % 1009) + 40 * (i % 50), (i * 7 % 11) / 100, (i * 5 % 9) / 100)
            for i in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_discount double, l_tax double").repartition(3).write.parquet(f"{path}/lineitem.parquet")
    parts = [(i, i * 3 % 17 + 1, 900.0 + i * 13 % 23) for i in range(20)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_models_are_fitted_at_the_same_time(spark, monkeypatch):
    from tabsight.operators import models
    met = threading.Barrier(2, timeout=60)

    class Waits:
        def __init__(self, value):
            self.value = value

        def hasParam(self, name):  # noqa: N802
            return False

        def fit(self, df):
            met.wait()
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.lit(self.value))

    class Fails(Waits):
        def fit(self, df):
            raise ValueError("no")
    monkeypatch.setattr(models, "catalogue", lambda *a, **k: {"a": Waits(1.0), "bad": Fails(0.0), "b": Waits(3.0)})
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(40)], "id long, label double").withColumn("features", F.lit(0))
    board, fitted, _ = models.train_all(df, df, "regression", "id")
    got = {r["model"]: r for r in board.collect()}
    assert got["a"]["error"] is None and got["b"]["error"] is None and got["bad"]["error"] == "ValueError: no"
    assert got["a"]["rmse"] == got["b"]["rmse"] and got["bad"]["rmse"] is None and sorted(fitted) == ["a", "b"]


def test_boosting_has_no_node_cache_and_the_same_settings(spark):
    from tabsight.operators import models
    for kind in ("classification", "regression"):
        est = models.catalogue(kind, 100, 2)
        assert est["gradient_boosting"].getMaxIter() == 50 and est["gradient_boosting"].getMaxDepth() == 3
        assert not est["gradient_boosting"].getCacheNodeIds() and est["random_forest"].getCacheNodeIds()


def test_preprocess_returns_the_scaled_features(spark, tmp_path):
    from tabsight.plans.catalog_models import q_preprocess
    out = q_preprocess(spark, _tables(spark, tmp_path)).toPandas()
    feats = [c for c in out.columns if c not in ("row_id", "label", "split") and not c.endswith("_scaled")]
    assert "l_quantity" in feats and len(out) == sum(i % 21 < 20 for i in range(400))
    assert [c for c in out.columns if c.endswith("_scaled")] == [f"{c}_scaled" for c in feats]
    train = out[out["split"] == "train"]
    for c in feats:
        sd = train[c].std(ddof=0)
        want = (out[c] - train[c].mean()) / sd if sd > 0 else out[c] * 0
        assert np.allclose(out[f"{c}_scaled"], want, atol=1e-8)
    assert (train["l_quantity"] - train["l_quantity_scaled"]).abs().max() > 1


def test_packed_checkpoint_keeps_rows_and_is_smaller(spark):
    from pathlib import Path

    from tabsight.session import cut_lineage, cut_lineage_packed
    df = spark.range(0, 40_000, 1, 3).select(
        "id", F.md5(F.col("id").cast("string")).alias("s"), (F.col("id") % 11 / 100).alias("x"),
        F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 7 > 0, F.col("id") * 0.5).otherwise(float("nan"))).alias("gap"),
        F.when(F.col("id") % 3 > 0, F.unhex(F.md5(F.col("id").cast("string")))).alias("b"))
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def size():
        return sum(f.stat().st_size for f in top.rglob("part-*"))
    before = size()
    plain = cut_lineage(df)
    middle = size()
    packed = cut_lineage_packed(df)
    assert size() - middle < 0.6 * (middle - before)
    assert packed.schema == df.schema and packed.rdd.getNumPartitions() == 3
    assert [str(r) for r in packed.collect()] == [str(r) for r in plain.collect()]
    assert cut_lineage_packed(df.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_forest_on_blocks_has_the_importances_of_one_on_rows(spark, kind):
    from tabsight.operators import block_forest, forest, models
    rng = np.random.default_rng(3)
    n = 6000
    a, b, c = rng.integers(0, 5, n).astype(float), rng.normal(size=n), rng.integers(0, 3, n).astype(float)
    y = 1e6 + 3 * a + 4 * (b > 0.3) + rng.normal(size=n)
    if kind == "classification":
        y = (y > 1e6 + 7).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, label double").repartition(3)
    df = models.assemble(df, ["a", "b", "c"])
    want = forest.fit_forest(df, kind, 20, 5).featureImportances.toArray()
    m = block_forest.block_forest(df, kind, 20, 5)
    got = m.featureImportances.toArray()
    assert np.abs(got - want).max() < 0.08 and got.sum() == pytest.approx(1) and len(m.trees) == 20
    assert [len(e) for e in m.edges] == [4, 31, 2]
    share = np.bincount(np.searchsorted(m.edges[1], b), minlength=32) / n
    assert abs(share - 1 / 32).max() < 0.01 and len({tuple(t.cut) for t in m.trees}) > 1
    assert np.array_equal(block_forest.block_forest(df, kind, 20, 5).featureImportances.toArray(), got)
    with pytest.raises(ValueError):
        block_forest.block_forest(df.withColumn("label", F.when(F.col("a") > 0, F.col("label"))), kind, 2, 2)


def test_sums_of_a_block_and_their_best_split():
    from tabsight.operators import block_forest as B
    from tabsight.operators.boosting import BinTree
    rng = np.random.default_rng(1)
    bins, y = rng.integers(0, 6, (4, 300)).astype(np.uint8), rng.normal(size=300)
    w = B.DRAW[rng.integers(0, 1 << 16, (2, 300))]
    tree = BinTree()
    low, high = tree.split(0, 2, 3)
    tree.split(high, 1, 2)  # a level deeper on one side only
    got = B.block_sums(bins, y, w, [tree, BinTree()], [{low: 0, high + 2: 1}, {}], [np.array([[0, 3], [1, 2]]), np.zeros((0, 2), int)], 0)
    assert got[0].shape == (2, 2, B.BINS, 2) and got[1].size == 0
    at = tree.nodes_of(bins.T)
    for slot, (node, own) in enumerate([(low, (0, 3)), (high + 2, (1, 2))]):
        for j, f in enumerate(own):
            for b in range(6):
                rows = (at == node) & (bins[f] == b)
                assert np.allclose(got[0][slot, j, b], [w[0][rows].sum(), (w[0] * y)[rows].sum()])
    j, cut, gain = B.best_split(got[0][0], [6, 6])

    def spread(rows):
        return (w[0][rows] * (y[rows] - np.average(y[rows], weights=w[0][rows])) ** 2).sum() if w[0][rows].any() else 0
    node = at == low
    falls = {(k, c): spread(node) - spread(node & (bins[f] <= c)) - spread(node & (bins[f] > c)) for k, f in enumerate((0, 3)) for c in range(5)}
    assert max(falls, key=falls.get) == (j, cut) and falls[j, cut] == pytest.approx(gain)
    assert abs(B.DRAW.mean() - 1) < 1e-3 and abs((B.DRAW == 0).mean() - np.exp(-1)) < 1e-4


def test_large_tables_are_packed_and_give_the_same_rows(spark, tmp_path, monkeypatch):
    from tabsight.operators import block_forest, forest
    from tabsight.plans import catalog_models as C
    path = _tables(spark, tmp_path, 3000)
    rows = C.q_select_features(spark, path).toPandas()
    ready = C.q_preprocess(spark, path).toPandas()
    cuts, fits, real, fit = [], [], C.cut_lineage_packed, block_forest.block_forest
    monkeypatch.setattr(C, "cut_lineage_packed", lambda df: (cuts.append(df.columns), real(df))[1])
    monkeypatch.setattr(block_forest, "block_forest", lambda *a: (fits.append(fit(*a)), fits[-1])[1])
    monkeypatch.setattr(forest, "DIRECT", 2000)
    large = C.q_select_features(spark, path).toPandas()
    assert "row_id" not in cuts[0] and len(fits) == 1
    assert sorted(large["feature"]) == sorted(rows["feature"])
    # the squares and logs of a column split as it does: which of them is taken is chance
    got, want = (d.groupby(d["feature"].str.contains("l_quantity"))["importance"].sum() for d in (large, rows))
    assert abs(got[True] - want[True]) < 0.03 and want[True] > 0.8
    assert C.q_top_selected_features(spark, path).toPandas().equals(
        large[~large["dropped"]].head(15)[["feature", "importance"]].reset_index(drop=True))
    kept = C.q_preprocess(spark, path).toPandas()
    assert len(cuts) == len(fits) == 3 and len(kept) == len(ready)
    both = [c for c in kept.columns if c in ready.columns]
    assert {"row_id", "label", "split", "l_quantity_scaled", "p_size"} <= set(both)
    for c in both:
        a, b = (d.sort_values("row_id")[c].to_numpy() for d in (kept, ready))
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9) if a.dtype.kind == "f" else (a == b).all()


def test_many_values_are_a_regression_without_counting_them_exactly(spark, monkeypatch):
    from tabsight.operators import columns
    from tabsight.plans import preprocess
    exact, real = [], columns.infer_problem
    monkeypatch.setattr(columns, "infer_problem", lambda df, t, **k: (exact.append(k.get("exact", True)), real(df, t, **k))[1])
    df = spark.range(3000).select(F.col("id").cast("double").alias("y"), F.col("id").cast("string").alias("s"), (F.col("id") % 20).alias("few"), (F.col("id") % 21).alias("more"))
    assert [preprocess._kind(df, c) for c in ("y", "s", "few", "more")] == ["regression", "classification", "classification", "regression"]
    assert exact == [False, False, False, True, False, True]
    assert preprocess._kind(df, None) == "clustering"
