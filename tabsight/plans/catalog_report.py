"""Phase 8 queries: explanation, report facts, model persistence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import outliers as O
from tabsight.operators import profile as P
from tabsight.operators.report import report_facts
from tabsight.plans.catalog_evaluate import CC_SQL, rule_scores
from tabsight.plans.catalog_profile import EVENT_NUM
from tabsight.plans.registry import query, table
from tabsight.session import checkpoint_dir, spread


def _forest(spark, sf_dir):
    """(prepared classification problem, its random forest)"""
    from pyspark.ml.classification import RandomForestClassifier
    from tabsight.operators.models import FOREST_DEPTH, FOREST_TREES, SEED, TREE_OPTS
    from tabsight.plans.catalog_models import _prep_cls
    pc = _prep_cls(spark, sf_dir)
    forest = RandomForestClassifier(numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH, seed=SEED, **TREE_OPTS)
    return pc, forest.fit(spread(pc.train))


@query("sampled_attributions")
def q_sampled_attributions(spark, sf_dir):
    """Sampled Shapley values (10 seeded permutations) of the random forest
    on the classification problem, explained on every test row: the 18
    features of highest mean |attribution|, for each class."""
    from tabsight.operators.explain import sampled_attributions
    pc, m = _forest(spark, sf_dir)
    return sampled_attributions(m, pc.test, pc.train, pc.id_col, "features", pc.feature_cols, 10,
                                output="probability", top=18)


@query("top_feature_attributions")
def q_top_feature_attributions(spark, sf_dir):
    """The most influential feature's value and attribution on every test row."""
    from tabsight.operators.explain import top_feature_pairs
    pc, m = _forest(spark, sf_dir)
    return top_feature_pairs(m, pc.test, pc.train, pc.id_col, "features", pc.feature_cols, 10, output="probability")


#: The classification problem's held-out documents, as ``_prep_cls`` splits them.
HELD_OUT_SQL = """(SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id)
  WHERE CAST(('0x' || substr(md5('42|' || CAST(l.doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 >= 80)"""


@query("tree_attributions")
def q_tree_attributions(spark, sf_dir):
    """Exact path-dependent Shapley values of the random forest on every test
    row: the 18 features of highest mean |attribution|, for each class."""
    from tabsight.operators.tree_explain import attribution_ranking, tree_attributions
    pc, m = _forest(spark, sf_dir)
    return attribution_ranking(tree_attributions(m, pc.test, pc.id_col, "features", pc.feature_cols), 18)


@query("tree_attribution_sums", f"""
SELECT t.doc_id, c.class, true AS adds_up
FROM {HELD_OUT_SQL} t, (SELECT CAST(range AS INTEGER) AS class FROM range((SELECT count(DISTINCT quality) FROM labels))) c
""")
def q_tree_attribution_sums(spark, sf_dir):
    """Whether the forest's attributions of each test row and class add up to
    its probability minus the expectation."""
    from pyspark.ml.functions import vector_to_array
    from tabsight.operators.tree_explain import expectation, pack_model, tree_attributions
    pc, m = _forest(spark, sf_dir)
    trees = pack_model(m)
    sums = (tree_attributions(trees, pc.test, pc.id_col, "features", pc.feature_cols)
            .groupBy(pc.id_col, "class").agg(F.sum("attribution").alias("s")))
    p = m.transform(pc.test).select(pc.id_col, vector_to_array("probability").alias("p"))
    base = F.array(*[F.lit(v) for v in expectation(trees)])
    gap = F.col("s") + F.get(base, F.col("class")) - F.get("p", F.col("class"))
    return sums.join(p, pc.id_col).select("doc_id", "class", (F.abs(gap) < 1e-9).alias("adds_up"))


@query("kernel_attributions")
def q_kernel_attributions(spark, sf_dir):
    """Shapley values by weighted least squares over coalitions (50
    coalitions, 30 background rows) of a logistic regression, a model without
    importances, on every test row."""
    from pyspark.ml.classification import LogisticRegression
    from tabsight.operators.kernel_explain import kernel_attributions
    from tabsight.operators.tree_explain import attribution_ranking
    from tabsight.plans.catalog_models import _prep_cls
    pc = _prep_cls(spark, sf_dir)
    m = LogisticRegression(featuresCol="features_scaled", maxIter=500).fit(pc.train)
    per = kernel_attributions(m, pc.test, pc.train, pc.id_col, "features_scaled", pc.feature_cols, output="probability")
    return attribution_ranking(per, 18)


@query("report_facts", f"""
WITH {CC_SQL},
ev AS (SELECT count(*) AS n FROM events),
oc AS (SELECT string_agg(c, ', ' ORDER BY c) AS cols FROM (
  SELECT 'value' AS c WHERE (SELECT count(*) FROM events, (SELECT avg(value) mu, stddev_pop(value) sd,
      quantile_cont(value, .25) q1, quantile_cont(value, .75) q3 FROM events) s
      WHERE (sd > 0 AND abs(value - mu) / sd > 3) OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) > 0
  UNION ALL
  SELECT 'user_id' WHERE (SELECT count(*) FROM events, (SELECT avg(user_id) mu, stddev_pop(user_id) sd,
      quantile_cont(user_id, .25) q1, quantile_cont(user_id, .75) q3 FROM events) s
      WHERE (sd > 0 AND abs(user_id - mu) / sd > 3) OR user_id < q1 - 1.5 * (q3 - q1) OR user_id > q3 + 1.5 * (q3 - q1)) > 0
  UNION ALL
  SELECT 'event_id' WHERE (SELECT count(*) FROM events, (SELECT avg(event_id) mu, stddev_pop(event_id) sd,
      quantile_cont(event_id, .25) q1, quantile_cont(event_id, .75) q3 FROM events) s
      WHERE (sd > 0 AND abs(event_id - mu) / sd > 3) OR event_id < q1 - 1.5 * (q3 - q1) OR event_id > q3 + 1.5 * (q3 - q1)) > 0) t),
top AS (SELECT model, accuracy, row_number() OVER (ORDER BY accuracy DESC NULLS LAST, model) AS rk FROM scores)
SELECT 'dataset' AS section, 'rows' AS "key", CAST(n AS VARCHAR) AS value FROM ev
UNION ALL SELECT 'dataset', 'columns', '6'
UNION ALL SELECT 'dataset', 'missing', CAST((SELECT count(*) FILTER (WHERE event_id IS NULL) + count(*) FILTER (WHERE ts IS NULL)
  + count(*) FILTER (WHERE user_id IS NULL) + count(*) FILTER (WHERE event_type IS NULL)
  + count(*) FILTER (WHERE value IS NULL OR isnan(value)) + count(*) FILTER (WHERE props IS NULL) FROM events) AS VARCHAR)
UNION ALL SELECT 'dataset', 'problem', CASE WHEN count(DISTINCT value) <= 20 THEN 'classification' ELSE 'regression' END FROM events
UNION ALL SELECT 'dataset', 'target', 'value'
UNION ALL SELECT 'dataset', 'features', 'event_id, user_id'
UNION ALL SELECT 'outliers', 'columns', coalesce(cols, '') FROM oc
UNION ALL SELECT 'models', 'best', model FROM top WHERE rk = 1
UNION ALL SELECT 'models', 'best_score', printf('%.4f', accuracy) FROM top WHERE rk = 1
UNION ALL SELECT 'models', 'top3', string_agg(model, ', ' ORDER BY rk) FROM top WHERE rk <= 3
""")
def q_report_facts(spark, sf_dir):
    """E11 on ``events`` (target ``value``), with the rule leaderboard."""
    from tabsight.operators.columns import infer_problem
    ev = table(spark, sf_dir, "events")
    return report_facts(P.dataset_summary(ev), infer_problem(ev, "value").first()["problem"], "value",
                        [c for c in EVENT_NUM if c != "value"], rule_scores(spark, sf_dir), "accuracy",
                        O.outlier_comparison(ev, EVENT_NUM))


@query("report_facts_models")
def q_report_facts_models(spark, sf_dir):
    """E11 with the facts of fitted models: anomalies on ``events`` and the
    best clustering of ``embeddings``."""
    from tabsight.operators.anomaly import isolation_forest
    from tabsight.plans.catalog_cluster import q_cluster_leaderboard
    ev = table(spark, sf_dir, "events")
    return report_facts(P.dataset_summary(ev), "clustering", anomalies=isolation_forest(ev, "event_id", ["user_id", "value"]),
                        clusters=q_cluster_leaderboard(spark, sf_dir))


@query("save_load_model")
def q_save_load_model(spark, sf_dir):
    """Scaler + logistic regression as one PipelineModel, saved under
    the shared checkpoint folder, loaded back; predictions compared."""
    import uuid

    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from tabsight.plans.catalog_models import _prep_cls
    from tabsight.sources.io import load_model, save_model
    pc = _prep_cls(spark, sf_dir)
    pipe = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="__z", withMean=True, withStd=True),
                            LogisticRegression(featuresCol="__z", maxIter=500)])
    model = pipe.fit(pc.train)
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    save_model(model, path)
    loaded = load_model(path)
    a = model.transform(pc.test).select(pc.id_col, F.col("prediction").alias("prediction_saved"))
    b = loaded.transform(pc.test).select(pc.id_col, F.col("prediction").alias("prediction_loaded"))
    return a.join(b, pc.id_col).withColumn("same", F.col("prediction_saved") == F.col("prediction_loaded"))
