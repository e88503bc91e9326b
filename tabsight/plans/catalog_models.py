"""Phase 5 queries: model catalogue, tuning, importances, kNN, linear fits."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F

from tabsight.operators import forest
from tabsight.operators import models as M
from tabsight.operators.knn import knn_predict
from tabsight.operators.features import train_test_split
from tabsight.plans.preprocess import prepare
from tabsight.plans.registry import query, table
from tabsight.session import cut_lineage, cut_lineage_packed, get_spark, spread  # noqa: F401  (scripts)


def classification_input(spark, sf_dir):
    """labels ⋈ documents: target ``quality``; features length, language,
    source and whitespace token count."""
    from tabsight.functions.text import token_count
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", "lang", "source", token_count(F.col("text")).alias("n_tokens"))
    return lab.join(docs, "doc_id")


def regression_input(spark, sf_dir, binary_ids=False):
    """lineitem ⋈ part: target ``l_extendedprice``.  ``lineitem`` has no
    short unique key, so the row id is an md5 over its key columns and
    measures (unique at every scale); its 16 bytes if ``binary_ids``."""
    li = table(spark, sf_dir, "lineitem")
    rid = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in li.columns]))
    rid = F.unhex(rid) if binary_ids else rid
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size")
    return li.select(rid.alias("row_id"), "l_partkey", "l_quantity", "l_discount", "l_tax",
                     "l_extendedprice").join(part, "l_partkey").drop("l_partkey")


def _prep_cls(spark, sf_dir):
    # the texts are read and split once, not in every pass of the preparation and the fits
    return prepare(cut_lineage(classification_input(spark, sf_dir)), "quality", "doc_id")


def _prep_reg(spark, sf_dir, **kw):
    # the preparation reads its rows about ten times: the join and the ids are made once
    return prepare(cut_lineage(regression_input(spark, sf_dir)), "l_extendedprice", "row_id", **kw)


def _is_large(spark, sf_dir):
    """Whether the rows of the regression problem are kept packed."""
    return table(spark, sf_dir, "lineitem").count() > forest.DIRECT


@query("train_leaderboard")
def q_train_leaderboard(spark, sf_dir):
    """Every catalogue model on both problems, scored on the held-out 20 %."""
    from pyspark import inheritable_thread_target

    def board(prep):
        p = prep(spark, sf_dir)
        train, test = spread(p.train).persist(), spread(p.test).persist()  # read by every fit, on all cores
        lb, _, _ = M.train_all(train, test, p.kind, p.id_col)
        out = spark.createDataFrame(lb.collect(), lb.schema)  # one row per model
        train.unpersist()
        test.unpersist()
        return out
    with ThreadPool(2) as pool:  # the problems do not wait for each other
        lb_c, lb_r = pool.map(inheritable_thread_target(spark)(board), (_prep_cls, _prep_reg), chunksize=1)
    return (lb_c.select(F.lit("classification").alias("problem"), "*")
            .unionByName(lb_r.select(F.lit("regression").alias("problem"), "*"), allowMissingColumns=True))


@query("tuned_models")
def q_tuned_models(spark, sf_dir):
    """Grid search with 3-fold CV: forest trees × depth (one fit per fold) and
    logistic C (shared passes) on the classification problem, ridge alpha (one
    scan) on the regression problem."""
    from tabsight.operators.tuning import fold_of, tune_forest, tune_logistic, tune_ridge
    pc, pr = _prep_cls(spark, sf_dir), _prep_reg(spark, sf_dir)
    tr = spread(fold_of(pc.train, pc.id_col, M.CV_FOLDS)).persist()
    p, scores, _ = tune_forest(tr, "classification", M.GRID_FOREST["numTrees"], M.GRID_FOREST["maxDepth"], seed=M.SEED, **M.TREE_OPTS)
    rows = [("random_forest", str(sorted(p.items())), max(s for *_, s in scores))]
    c, scores, _, _ = tune_logistic(tr, M.GRID_LOGREG_C, "features_scaled", rounds=M.LOGREG_ITER)
    rows.append(("logistic_regression", str([("C", c)]), dict(scores)[c]))
    tr.unpersist()
    alpha, scores, _ = tune_ridge(fold_of(pr.train, pr.id_col, M.CV_FOLDS), M.GRID_RIDGE_ALPHA, "features_scaled")
    rows.append(("ridge", str([("alpha", alpha)]), dict(scores)[alpha]))
    return spark.createDataFrame(rows, "model string, best_params string, cv_score double").select(
        "model", "best_params", F.round("cv_score", 4).alias("cv_score"))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    from tabsight.operators.forest import fit_forest
    pr = _prep_reg(spark, sf_dir)
    m = fit_forest(pr.train, "regression", M.FOREST_TREES, M.FOREST_DEPTH, seed=M.SEED, deal=spread, **M.TREE_OPTS)
    return M.feature_importance(m, pr.feature_cols, 20, spark=spark)


def _engineered(spark, sf_dir):
    """(train rows of the regression problem with engineered features fitted
    on them, base columns, generated columns)"""
    from tabsight.operators.features import auto_features
    base = ["l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size"]
    if _is_large(spark, sf_dir):  # the ids are dropped before the join
        train = cut_lineage_packed(train_test_split(regression_input(spark, sf_dir), "row_id")
                                   .where(F.col("split") == "train").drop("row_id", "split"))
    else:
        train = train_test_split(cut_lineage(regression_input(spark, sf_dir)), "row_id").where(F.col("split") == "train")
    train, generated = auto_features(train, base)
    return spread(train.withColumn("label", F.col("l_extendedprice"))), base, generated


@query("select_features")
def q_select_features(spark, sf_dir):
    """Engineered features of the regression problem, kept or dropped by
    forest importance (threshold 0.1 × mean); all fitted on train rows."""
    train, base, generated = _engineered(spark, sf_dir)
    _, tbl, _ = M.select_features(train, base + generated, generated, "label", "regression")
    return tbl


@query("linear_attributions")
def q_linear_attributions(spark, sf_dir):
    """Exact Shapley values of least squares on the scaled regression
    features: mean |w·(x − mean)| per feature on the test rows."""
    from pyspark.ml.regression import LinearRegression
    pr = _prep_reg(spark, sf_dir)
    m = LinearRegression(regParam=0.0, solver="normal", featuresCol="features_scaled").fit(pr.train)
    return M.linear_attributions(m, pr.test, pr.feature_cols, "features_scaled", background=pr.train)


@query("linear_simple", """
SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem
""")
def q_linear_simple(spark, sf_dir):
    from pyspark.ml.regression import LinearRegression
    li = M.assemble(table(spark, sf_dir, "lineitem"), ["l_quantity"])
    m = LinearRegression(regParam=0.0, solver="normal", labelCol="l_extendedprice").fit(li)
    return spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]))], "intercept double, slope double") \
        .select(F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"))


EMB_SPLIT_SQL = "(CAST(('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100)"


@query("knn_predict", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, {EMB_SPLIT_SQL} < 80 AS is_train FROM embeddings),
tr AS (SELECT * FROM e WHERE is_train), te AS (SELECT * FROM e WHERE NOT is_train),
d AS (SELECT te.vec_id, tr.vec_id AS nb, tr.label AS y,
             row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance(te.v, tr.v), tr.vec_id) AS rk
      FROM te, tr),
v AS (SELECT vec_id, y, count(*) AS n FROM d WHERE rk <= 5 GROUP BY vec_id, y)
SELECT vec_id, CAST(arg_min(y, [-n, y]) AS INTEGER) AS prediction, (SELECT label FROM te WHERE te.vec_id = v.vec_id) AS label
FROM v GROUP BY vec_id
""")
def q_knn_predict(spark, sf_dir):
    e = train_test_split(table(spark, sf_dir, "embeddings"), "vec_id")
    tr, te = e.where(F.col("split") == "train"), e.where(F.col("split") == "test")
    p = knn_predict(tr, te, "vec_id", "embedding", "label", 5, "classification")
    return p.join(te.select("vec_id", "label"), "vec_id").select(
        "vec_id", F.col("prediction").cast("int").alias("prediction"), "label")


@query("ann_recall", f"""
SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings
WHERE {EMB_SPLIT_SQL} >= 80
""")
def q_ann_recall(spark, sf_dir):
    """Whether the approximate index finds at least 0.9 of the five nearest
    training rows of the held-out embeddings."""
    from tabsight.operators.ann import recall
    e = train_test_split(table(spark, sf_dir, "embeddings"), "vec_id")
    tr, te = e.where(F.col("split") == "train"), e.where(F.col("split") == "test")
    return recall(tr, te, "vec_id", "embedding", 5).select("n_queries", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("ann_neighbours")
def q_ann_neighbours(spark, sf_dir):
    """Five nearest training rows of every held-out embedding by the
    approximate index, with the distances each query computed."""
    from tabsight.operators.ann import ann_neighbours, candidates
    e = train_test_split(table(spark, sf_dir, "embeddings"), "vec_id")
    tr, te = e.where(F.col("split") == "train"), e.where(F.col("split") == "test")
    nb = ann_neighbours(tr, te, "vec_id", "embedding", 5)
    return nb.join(candidates(tr, te, "vec_id", "embedding"), "vec_id").select(
        "vec_id", "neighbour_id", F.round("dist", 6).alias("dist"), "rank", "candidates")


def _boosted(spark, sf_dir):
    """(train, test, softmax boosting) of the embeddings' ten labels."""
    from tabsight.operators.boosting import SoftmaxBoosting
    from tabsight.operators.cluster import to_vector
    e = train_test_split(to_vector(table(spark, sf_dir, "embeddings"), "embedding"), "vec_id")
    train, test = (e.where(F.col("split") == s).select("vec_id", "label", "features") for s in ("train", "test"))
    return train, test, SoftmaxBoosting(M.BOOST_ROUNDS, M.BOOST_DEPTH, M.BOOST_STEP).fit(train)


@query("softmax_boosting")
def q_softmax_boosting(spark, sf_dir):
    """One boosting model for ten classes: predictions on the held-out rows."""
    _, test, m = _boosted(spark, sf_dir)
    return m.transform(test).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query("softmax_boosting_loss", f"""
SELECT CAST(range AS INTEGER) AS round, true AS falls FROM range(1, {M.BOOST_ROUNDS + 1})
""")
def q_softmax_boosting_loss(spark, sf_dir):
    """Whether the training loss falls in every round."""
    _, _, m = _boosted(spark, sf_dir)
    return spark.createDataFrame([(r, bool(b < a)) for r, (a, b) in enumerate(zip(m.loss, m.loss[1:]), 1)], "round int, falls boolean")


@query("preprocess")
def q_preprocess(spark, sf_dir):
    """X8 end to end on the regression problem: encode, impute, engineer
    (squares, neighbour products, logs, quartile bins), select by forest
    importance (fitted on the train split), scale → model-ready rows: each
    feature as it is and, in ``<feature>_scaled``, standardised."""
    from pyspark.ml.functions import vector_to_array
    if _is_large(spark, sf_dir):
        rows = regression_input(spark, sf_dir, binary_ids=True)
        named = F.lower(F.hex("row_id"))
        # rows are split once: a hash of the id in every pass costs more than the rest of it
        rows = cut_lineage_packed(train_test_split(rows.withColumn("__id", named), "__id").drop("__id"))
        pr = prepare(rows.withColumn("row_id", named), "l_extendedprice", "row_id", auto_fe=True, select=True, presplit=True)
    else:
        pr = _prep_reg(spark, sf_dir, auto_fe=True, select=True)
    out, z = pr.train.unionByName(pr.test), vector_to_array("features_scaled")
    return out.select(*[c for c in out.columns if c not in ("features", "features_scaled")],
                      *[z[i].alias(f"{c}_scaled") for i, c in enumerate(pr.feature_cols)])


@query("preprocess_text")
def q_preprocess_text(spark, sf_dir):
    """X8 with a text column: labelled documents, TF-IDF fitted on the train
    rows, non-zero entries of the prepared vectors in long form."""
    from pyspark.ml.functions import vector_to_array
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    pr = prepare(lab.join(docs, "doc_id"), "quality", "doc_id", text_col="text")
    names = F.array(*[F.lit(c) for c in pr.feature_cols + [f"tfidf_{t}" for t in pr.terms]])
    x = F.filter(F.transform(vector_to_array("features"), lambda v, i: F.struct(i.alias("i"), v.alias("value"))),
                 lambda e: e["value"] != 0)
    rows = pr.train.unionByName(pr.test).select("doc_id", "label", "split", F.inline(x))
    return rows.select("doc_id", "label", "split", F.get(names, F.col("i")).alias("feature"), F.round("value", 6).alias("value"))


@query("top_selected_features")
def q_top_selected_features(spark, sf_dir):
    """The 15 most important kept features after selection."""
    train, base, generated = _engineered(spark, sf_dir)
    _, tbl, _ = M.select_features(train, base + generated, generated, "label", "regression")
    return M.top_selected_features(tbl, 15)


@query("clustering_input", f"""
WITH c AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, CAST(c_acctbal AS DOUBLE) AS bal, c_mktsegment,
                  {EMB_SPLIT_SQL.replace('vec_id', 'c_custkey')} < 80 AS is_train FROM customer),
codes AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS seg
          FROM (SELECT DISTINCT c_mktsegment FROM c WHERE is_train)),
x AS (SELECT c.*, seg FROM c LEFT JOIN codes USING (c_mktsegment)),
s AS (SELECT avg(nation) AS m1, stddev_pop(nation) AS s1, avg(bal) AS m2, stddev_pop(bal) AS s2, avg(seg) AS m3, stddev_pop(seg) AS s3
      FROM x WHERE is_train)
SELECT c_custkey, CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, round((nation - m1) / s1, 6) AS c_nationkey,
       round((bal - m2) / s2, 6) AS c_acctbal, round((seg - m3) / s3, 6) AS c_mktsegment_code FROM x, s
""")
def q_clustering_input(spark, sf_dir):
    """X8 without a target: customers with encoded, imputed and standardised
    columns, ready for clustering."""
    from pyspark.ml.functions import vector_to_array
    pr = prepare(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), None, "c_custkey")
    rows = pr.train.unionByName(pr.test)
    return rows.select("c_custkey", "split", *[F.round(vector_to_array("features_scaled")[i], 6).alias(c)
                                               for i, c in enumerate(pr.feature_cols)])
