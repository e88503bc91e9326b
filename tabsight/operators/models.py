"""Supervised models, tuning and leaderboards.

Every estimator is a Spark ML estimator fitted on a DataFrame with a
``features`` vector column; the loop over the catalogue runs on the driver
(one distributed fit per model) and a failing model becomes a row with its
error instead of disappearing.  Settings follow the original tool:

* random forest: 50 trees, depth 12, seed 42
* gradient boosting: 50 rounds, depth 3, step 0.1 (more than two classes:
  ``tabsight.operators.boosting``, as ``GBTClassifier`` is binary)
* logistic regression: L2 with C = 1 → regParam = 1 / (C · n), no internal
  standardisation (inputs are scaled), 500 iterations
* linear regression: ordinary least squares
* ridge: alpha = 1 → regParam = alpha · std_pop(y) / n, no standardisation
* decision tree: depth 10
* k nearest neighbours: k = 5, Euclidean (``tabsight.operators.knn``)
"""

from __future__ import annotations

import traceback
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.evaluate import classification_scores, regression_scores
from tabsight.session import cut_lineage, dealt

MAX_TREE_DEPTH = 30  # Spark's limit; "unlimited" depth maps here

# --- fixed values: model settings and tuning grids of the original tool ---
FOREST_TREES, FOREST_DEPTH = 50, 12
BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP = 50, 3, 0.1
LOGREG_C, LOGREG_ITER = 1.0, 500
RIDGE_ALPHA = 1.0
TREE_DEPTH = 10
KNN_K = 5
SEED = 42
GRID_FOREST = {"numTrees": [50, 100], "maxDepth": [MAX_TREE_DEPTH, 10]}
GRID_LOGREG_C = [0.1, 1.0, 10.0]
GRID_RIDGE_ALPHA = [0.1, 1.0, 10.0, 100.0]
CV_FOLDS = 3
# ---------------------------------------------------------------------------

SCALED = {"logistic_regression", "knn", "linear_regression", "ridge"}

#: Models of a catalogue fitted at a time: boosting is a chain of short jobs,
#: which leave cores to the others.
FITS_AT_ONCE = 6

# Tree training: larger node-statistics batches mean fewer passes over the
# data per tree level; cached node ids avoid re-walking deep trees.
TREE_OPTS = {"maxMemoryInMB": 1024, "cacheNodeIds": True}
# Boosting's trees are shallow: walking them costs less than a cache per level.
BOOST_OPTS = TREE_OPTS | {"cacheNodeIds": False}


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def catalogue(kind: str, n_train: int, n_classes: int = 2, y_std: float | None = None,
              label: str = "label", features: str = "features") -> dict:
    """Name → Spark ML estimator (``knn`` → None: handled by the kNN operator)."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    common = dict(labelCol=label, featuresCol=features)
    if kind == "classification":
        gbt = C.GBTClassifier(maxIter=BOOST_ROUNDS, maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP, seed=SEED,
                              **BOOST_OPTS, **common)
        if n_classes > 2:
            from tabsight.operators.boosting import SoftmaxBoosting
            gbt = SoftmaxBoosting(BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP, label=label, features=features)
        return {
            "random_forest": C.RandomForestClassifier(numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH, seed=SEED,
                                                      **TREE_OPTS, **common),
            "gradient_boosting": gbt,
            "logistic_regression": C.LogisticRegression(regParam=1.0 / (LOGREG_C * max(n_train, 1)),
                                                        elasticNetParam=0.0, standardization=False,
                                                        maxIter=LOGREG_ITER, **common),
            "knn": None,
            "decision_tree": C.DecisionTreeClassifier(maxDepth=TREE_DEPTH, seed=SEED, **TREE_OPTS, **common),
        }
    ridge_reg = RIDGE_ALPHA * (y_std or 1.0) / max(n_train, 1)
    return {
        "random_forest": R.RandomForestRegressor(numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH, seed=SEED,
                                                   **TREE_OPTS, **common),
        "gradient_boosting": R.GBTRegressor(maxIter=BOOST_ROUNDS, maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP,
                                            seed=SEED, **BOOST_OPTS, **common),
        "linear_regression": R.LinearRegression(regParam=0.0, solver="normal", **common),
        "ridge": R.LinearRegression(regParam=ridge_reg, elasticNetParam=0.0, standardization=False,
                                    solver="normal", **common),
        "knn": None,
        "decision_tree": R.DecisionTreeRegressor(maxDepth=TREE_DEPTH, seed=SEED, **TREE_OPTS, **common),
    }


def optional_boosters(kind: str, label: str = "label", features: str = "features") -> dict:
    """Third-party Spark boosters (50 rounds, seed 42) for each package that is
    installed — none ships here; an installed one that fails is an error."""
    from importlib import import_module
    from importlib.util import find_spec
    classify = kind == "classification"
    out = {}
    if find_spec("xgboost"):  # pragma: no cover - not installed
        m = import_module("xgboost.spark")
        cls = m.SparkXGBClassifier if classify else m.SparkXGBRegressor
        out["xgboost"] = cls(n_estimators=BOOST_ROUNDS, random_state=SEED, label_col=label, features_col=features)
    if find_spec("synapse"):  # pragma: no cover - not installed
        m = import_module("synapse.ml.lightgbm")
        cls = m.LightGBMClassifier if classify else m.LightGBMRegressor
        out["lightgbm"] = cls(numIterations=BOOST_ROUNDS, seed=SEED, labelCol=label, featuresCol=features)
    if find_spec("catboost_spark"):  # pragma: no cover - not installed
        m = import_module("catboost_spark")
        cls = m.CatBoostClassifier if classify else m.CatBoostRegressor
        out["catboost"] = cls(iterations=BOOST_ROUNDS, randomSeed=SEED, labelCol=label, featuresCol=features)
    return out


def _vec_to_array(df: DataFrame, col: str, out: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return df.withColumn(out, vector_to_array(F.col(col)))


def train_all(train: DataFrame, test: DataFrame, kind: str, id_col: str, label: str = "label",
              raw: str = "features", scaled: str = "features_scaled", models: list[str] | None = None,
              n_classes: int | None = None):
    """Fit every catalogue model on ``train`` and score it on ``test``.

    ``raw``/``scaled``: vector columns (tree models use the raw features,
    the others the scaled ones).  Returns (leaderboard DataFrame, fitted
    models dict, predictions DataFrame (model, id, label, prediction)).
    """
    from pyspark import inheritable_thread_target
    spark = train.sparkSession
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col(label).cast("double")).alias("sd"),
                   F.countDistinct(label).alias("k")).first()
    n, sd, k = st["n"], st["sd"], st["k"]
    cat = catalogue(kind, n, n_classes or k, sd, label=label, features=raw)
    cat.update(optional_boosters(kind, label, raw))
    if models:
        cat = {m: e for m, e in cat.items() if m in models}

    def one(name: str):
        """(fitted model, predictions, error) of a model of the catalogue."""
        est, fcol = cat[name], scaled if name in SCALED else raw
        try:
            if name == "knn":
                from tabsight.operators.knn import knn_predict
                tr = _vec_to_array(train, fcol, "__vec")
                te = _vec_to_array(test, fcol, "__vec")
                m = None  # its search is made here, not when the scores are asked for
                p = cut_lineage(knn_predict(tr, te, id_col, "__vec", label, KNN_K, kind)).join(
                    test.select(id_col, label), id_col)
            else:
                est = est.copy({est.getParam("featuresCol"): fcol}) if est.hasParam("featuresCol") else est
                m = est.fit(train)
                p = m.transform(test).select(id_col, label, "prediction")
            return m, p.select(F.lit(name).alias("model"), id_col, F.col(label).alias("label"),
                               F.col("prediction").cast("double").alias("prediction")), None
        except Exception as e:  # noqa: BLE001
            traceback.print_exc()
            return None, None, f"{type(e).__name__}: {e}"[:500]
    with ThreadPool(FITS_AT_ONCE) as pool:
        found = pool.map(inheritable_thread_target(spark)(one), list(cat), chunksize=1)
    rows = [(name, error) for name, (_, _, error) in zip(cat, found)]
    fitted = {name: m for name, (m, _, error) in zip(cat, found) if error is None}
    preds = [p for _, p, _ in found if p is not None]
    if preds:
        allp = preds[0]
        for p in preds[1:]:
            allp = allp.unionByName(p)
    else:
        allp = spark.createDataFrame([], "model string, id long, label double, prediction double")
    if kind == "classification":
        scores = classification_scores(allp.withColumn("label", F.col("label").cast("double")), by=["model"])
        metric = "accuracy"
    else:
        scores = regression_scores(allp, by=["model"]).select("model", "r2", "rmse")
        metric = "r2"
    status = spark.createDataFrame(rows, "model string, error string")
    lb = status.join(scores, "model", "left").orderBy(F.desc_nulls_last(metric), "model")
    return lb, fitted, allp


def tune(estimator, grid: dict, train: DataFrame, kind: str, label: str = "label",
         features: str = "features", folds: int = CV_FOLDS, parallelism: int = 4, seed: int = SEED):
    """Grid search with k-fold cross-validation (accuracy / R²); returns the
    best refitted model, its params and mean CV score."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    b = ParamGridBuilder()
    for pname, values in grid.items():
        b = b.addGrid(estimator.getParam(pname), values)
    maps = b.build()
    ev = (MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy") if kind == "classification"
          else RegressionEvaluator(labelCol=label, metricName="r2"))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, numFolds=folds,
                        parallelism=parallelism, seed=seed)
    m = cv.fit(train)
    import numpy as np
    best = int(np.argmax(m.avgMetrics))
    params = {p.name: v for p, v in maps[best].items()}
    return m.bestModel, params, float(m.avgMetrics[best])


def feature_importance(model, names: list[str], n: int = 20, digits: int = 6, spark=None) -> DataFrame:
    """Top ``n`` importances with their running share (largest first) →
    (rank, feature, importance, cumulative_share)."""
    from pyspark.sql import SparkSession, Window
    spark = spark or SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()  # one value per feature: schema-sized
    df = spark.createDataFrame([(nm, float(v)) for nm, v in zip(names, imp)], "feature string, importance double")
    tot = df.agg(F.sum("importance").alias("__t"))
    w = Window.orderBy(F.desc("importance"), "feature")  # ≤ number of features
    out = (df.crossJoin(F.broadcast(tot)).withColumn("rank", F.row_number().over(w))
           .withColumn("__cum", F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return out.where(F.col("rank") <= n).select(
        "rank", "feature", F.round("importance", digits).alias("importance"),
        F.round(F.try_divide(F.col("__cum"), F.col("__t")), digits).alias("cumulative_share"))


def select_features(df: DataFrame, feature_cols: list[str], generated: list[str], label: str, kind: str,
                    threshold_factor: float = 0.1):
    """Forest importance (30 trees, depth 6) on the given rows; drop
    generated features whose importance is below ``threshold_factor`` × the
    mean importance.  Original features are always kept.  Above
    ``forest.DIRECT`` rows the forest is grown on blocks of bin numbers.  Returns
    (DataFrame without the dropped columns, importance table, dropped list)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    from tabsight.operators import block_forest, forest
    a = assemble(df.na.fill(0.0, subset=feature_cols), feature_cols, "__fs").select(label, "__fs")
    if df.count() > forest.DIRECT:
        m = block_forest.block_forest(a, kind, 30, 6, "__fs", label, SEED)
    else:
        cls = RandomForestClassifier if kind == "classification" else RandomForestRegressor
        m = cls(numTrees=30, maxDepth=6, seed=SEED, labelCol=label, featuresCol="__fs", **TREE_OPTS).fit(dealt(a))
    imp = m.featureImportances.toArray().tolist()
    mean = sum(imp) / len(imp) if imp else 0.0
    dropped = [c for c, v in zip(feature_cols, imp) if c in set(generated) and v < threshold_factor * mean]
    table = feature_importance(m, feature_cols, n=len(feature_cols), spark=df.sparkSession)
    table = table.withColumn("dropped", F.col("feature").isin(dropped) if dropped else F.lit(False))
    return df.drop(*dropped), table, dropped


def top_selected_features(importance: DataFrame, n: int = 15) -> DataFrame:
    """Importance order after removing the dropped features, top ``n``
    (``importance``: the table returned by ``select_features``)."""
    return (importance.where(~F.col("dropped")).orderBy(F.desc("importance"), "feature").limit(n)
            .select("feature", "importance"))


def linear_attributions(model, df: DataFrame, names: list[str], features: str = "features",
                        background: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """Exact Shapley values of a linear model: wᵢ · (xᵢ − mean(xᵢ)) with the
    mean over ``background`` (default: the rows given) → per feature the
    mean absolute attribution (feature, mean_abs_attribution, weight)."""
    from pyspark.ml.functions import vector_to_array
    w = model.coefficients.toArray().tolist()
    bg = background if background is not None else df
    arr = vector_to_array(F.col(features))
    means = bg.select(arr.alias("__a")).agg(*[F.avg(F.col("__a")[i]).alias(f"m{i}") for i in range(len(w))])
    x = df.select(arr.alias("__a")).crossJoin(F.broadcast(means))
    agg = x.agg(*[F.avg(F.abs(F.lit(w[i]) * (F.col("__a")[i] - F.col(f"m{i}")))).alias(f"a{i}")
                  for i in range(len(w))])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(names[i]).alias("feature"), F.round(F.col(f"a{i}"), digits).alias("mean_abs_attribution"),
                 F.round(F.lit(w[i]), digits).alias("weight")) for i in range(len(w))])))


def best_model(lb: DataFrame, metric: str):
    """First row of the leaderboard (the best tabular model)."""
    return lb.where(F.col("error").isNull()).orderBy(F.desc_nulls_last(metric), "model").limit(1)


