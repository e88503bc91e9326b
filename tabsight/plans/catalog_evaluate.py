"""Phase 4 queries: scoring tables on deterministic rule predictions.

Classification: ``labels ⋈ documents`` with the target ``quality`` and five
fixed rules as "models".  Regression: ``lineitem`` price against the least
squares line in quantity (coefficients rounded to 6 decimals so that both
engines predict the same numbers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import density as D
from tabsight.operators import evaluate as E
from tabsight.operators import profile as P
from tabsight.plans.registry import query, table
from tabsight.sources.io import union_all_by_name

# rule name → (Spark condition, SQL condition); prediction = 1 when true
# (conditions are built lazily: no Spark session is needed to import this module)
RULES = {
    "len_over_500": (lambda: F.col("n_chars") > 500, "n_chars > 500"),
    "len_over_2000": (lambda: F.col("n_chars") > 2000, "n_chars > 2000"),
    "len_over_8000": (lambda: F.col("n_chars") > 8000, "n_chars > 8000"),
    "lang_en": (lambda: F.col("lang") == "en", "lang = 'en'"),
    "always_1": (lambda: F.lit(True), "true"),
}


def rule_predictions(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    j = lab.join(docs, "doc_id")
    arr = F.array(*[F.struct(F.lit(k).alias("model"), cond().cast("int").alias("prediction"))
                    for k, (cond, _) in RULES.items()])
    return j.select("doc_id", "label", F.explode(arr).alias("r")).select("r.model", "doc_id", "label", "r.prediction")


RULE_PRED_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{k}' AS model, l.doc_id, l.quality AS label, CAST(({sql}) AS INTEGER) AS prediction "
    f"FROM labels l JOIN documents d USING (doc_id)" for k, (_, sql) in RULES.items()) + ")"

CC_SQL = f"""
cc AS (
  SELECT model, cls AS class, sum(a) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
    SELECT model, CAST(label AS VARCHAR) AS cls, 1 AS a, 0 AS p, CAST(label = prediction AS INTEGER) AS tp FROM {RULE_PRED_SQL}
    UNION ALL
    SELECT model, CAST(prediction AS VARCHAR), 0, 1, 0 FROM {RULE_PRED_SQL}) e
  GROUP BY model, cls),
prf AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
            CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
            CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM cc),
scores AS (
  SELECT model, round(sum(tp) / sum(support), 4) AS accuracy,
         round(sum(f1 * support) / sum(support), 4) AS f1_weighted FROM prf GROUP BY model)"""


def rule_scores(spark, sf_dir):
    return E.classification_scores(rule_predictions(spark, sf_dir), by=["model"])


@query("classification_scores", f"WITH {CC_SQL} SELECT * FROM scores")
def q_classification_scores(spark, sf_dir):
    return rule_scores(spark, sf_dir)


@query("best_model", f"""
WITH {CC_SQL}
SELECT model, accuracy, CASE WHEN accuracy > 0.9 THEN 'excellent' WHEN accuracy > 0.8 THEN 'very good'
                             WHEN accuracy > 0.7 THEN 'good' ELSE 'fair' END AS grade
FROM scores ORDER BY accuracy DESC NULLS LAST, model LIMIT 1
""")
def q_best_model(spark, sf_dir):
    """The first row of the leaderboard and the grade of its score."""
    from tabsight.functions.exprs import score_band
    from tabsight.operators.models import best_model
    board = rule_scores(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    return best_model(board, "accuracy").select("model", "accuracy", score_band(F.col("accuracy")).alias("grade"))


@query("confusion_matrix_named", """
WITH p AS (SELECT l.label AS actual_label, (l.label + CASE WHEN l.vec_id % 4 = 0 THEN 1 ELSE 0 END) % 10 AS guess FROM embeddings l),
names AS (SELECT DISTINCT label AS code, 'class ' || label AS name FROM embeddings),
cells AS (SELECT a.code AS a, a.name AS actual, b.code AS b, b.name AS predicted FROM names a, names b)
SELECT c.actual, c.predicted, (SELECT count(*) FROM p WHERE actual_label = c.a AND guess = c.b) AS "count" FROM cells c
""")
def q_confusion_matrix_named(spark, sf_dir):
    """Codes in the matrix are turned back into class names; every fourth
    row is guessed one class too high."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label"), ((F.col("label") + (F.col("vec_id") % 4 == 0).cast("int")) % 10).alias("prediction"))
    names = e.select(F.concat(F.lit("class "), F.col("label").cast("string")).alias("value"), F.col("label").alias("code")).distinct()
    return E.confusion_matrix(e, "label", "prediction", codes=names)


@query("confusion_matrix", f"""
WITH p AS (SELECT * FROM {RULE_PRED_SQL} r WHERE model = 'len_over_2000'),
cls AS (SELECT CAST(label AS VARCHAR) AS c FROM p UNION SELECT CAST(prediction AS VARCHAR) FROM p),
cnt AS (SELECT CAST(label AS VARCHAR) AS actual, CAST(prediction AS VARCHAR) AS predicted, count(*) AS n FROM p GROUP BY 1, 2)
SELECT a.c AS actual, b.c AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS "count"
FROM cls a CROSS JOIN cls b LEFT JOIN cnt ON cnt.actual = a.c AND cnt.predicted = b.c
""")
def q_confusion_matrix(spark, sf_dir):
    p = rule_predictions(spark, sf_dir).where(F.col("model") == "len_over_2000")
    return E.confusion_matrix(p)


@query("classification_report", f"""
WITH {CC_SQL},
one AS (SELECT * FROM prf WHERE model = 'len_over_2000'),
t AS (SELECT sum(support) AS n, sum(tp) AS tp, count(*) AS k, sum(precision) AS sp, sum(recall) AS sr, sum(f1) AS sf,
             sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM one)
SELECT class AS "row", round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1,
       CAST(support AS DOUBLE) AS support FROM one
UNION ALL SELECT 'accuracy', round(tp / n, 3), round(tp / n, 3), round(tp / n, 3), CAST(n AS DOUBLE) FROM t
UNION ALL SELECT 'macro avg', round(sp / k, 3), round(sr / k, 3), round(sf / k, 3), CAST(n AS DOUBLE) FROM t
UNION ALL SELECT 'weighted avg', round(wp / n, 3), round(wr / n, 3), round(wf / n, 3), CAST(n AS DOUBLE) FROM t
""")
def q_classification_report(spark, sf_dir):
    p = rule_predictions(spark, sf_dir).where(F.col("model") == "len_over_2000")
    return E.classification_report(p)


@query("leaderboard_rank", f"""
WITH {CC_SQL}
SELECT model, accuracy, f1_weighted, CAST(row_number() OVER (ORDER BY accuracy DESC NULLS LAST, model) AS INTEGER) AS rank,
       CASE row_number() OVER (ORDER BY accuracy DESC NULLS LAST, model) WHEN 1 THEN 'gold' WHEN 2 THEN 'silver'
            WHEN 3 THEN 'bronze' END AS medal,
       round(accuracy * 100.0 / max(accuracy) OVER (), 4) AS pct_of_best
FROM scores
""")
def q_leaderboard_rank(spark, sf_dir):
    return E.leaderboard(rule_scores(spark, sf_dir), "accuracy")


@query("radar_table", f"""
WITH {CC_SQL},
s AS (SELECT min(accuracy) AS lo_a, max(accuracy) AS hi_a, min(f1_weighted) AS lo_f, max(f1_weighted) AS hi_f FROM scores)
SELECT model,
       round(CASE WHEN hi_a > lo_a THEN (accuracy - lo_a) / (hi_a - lo_a) ELSE 0.5 END, 6) AS accuracy_norm,
       round(CASE WHEN hi_f > lo_f THEN (f1_weighted - lo_f) / (hi_f - lo_f) ELSE 0.5 END, 6) AS f1_weighted_norm
FROM scores, s ORDER BY accuracy DESC NULLS LAST, model LIMIT 4
""")
def q_radar_table(spark, sf_dir):
    return E.radar_table(rule_scores(spark, sf_dir), ["accuracy", "f1_weighted"], "accuracy")


@query("gauge_table", f"""
WITH {CC_SQL}
SELECT model, accuracy, round(least(accuracy / 1.0, 1.0), 6) AS fraction
FROM scores ORDER BY accuracy DESC NULLS LAST, model LIMIT 4
""")
def q_gauge_table(spark, sf_dir):
    return E.gauge_table(rule_scores(spark, sf_dir), "accuracy")


# ---------------------------------------------------------------- regression
def line_predictions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    coef = li.agg(F.round(F.covar_samp("l_quantity", "l_extendedprice") / F.var_samp("l_quantity"), 6).alias("b"),
                  F.avg("l_quantity").alias("mx"), F.avg("l_extendedprice").alias("my"))
    coef = coef.select("b", F.round(F.col("my") - F.col("b") * F.col("mx"), 6).alias("a"))
    return li.crossJoin(F.broadcast(coef)).select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"),
        (F.col("a") + F.col("b") * F.col("l_quantity")).alias("prediction"))


LINE_SQL = """(SELECT l_orderkey, l_linenumber, l_extendedprice AS label, a + b * l_quantity AS prediction
  FROM lineitem, (SELECT b, round(my - b * mx, 6) AS a FROM (
     SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS b, avg(l_quantity) AS mx,
            avg(l_extendedprice) AS my FROM lineitem) c0) c)"""


@query("regression_scores", f"""
SELECT CAST(count(label) AS BIGINT) AS n,
       round(1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(label)), 4) AS r2,
       round(sqrt(sum((label - prediction) ^ 2) / count(label)), 4) AS rmse,
       round(avg(abs(label - prediction)), 4) AS mae,
       round(avg(CAST(abs(label - prediction) <= abs(prediction) * 0.1 AS DOUBLE)), 4) AS share_in_band
FROM {LINE_SQL} p
""")
def q_regression_scores(spark, sf_dir):
    return E.regression_scores(line_predictions(spark, sf_dir))


@query("worst_predictions", f"""
SELECT l_orderkey, l_linenumber, round(label, 4) AS label, round(prediction, 4) AS prediction,
       round(label - prediction, 4) AS residual, round(abs(label - prediction), 4) AS abs_error,
       abs(label - prediction) <= abs(prediction) * 0.1 AS in_band
FROM {LINE_SQL} p ORDER BY abs(label - prediction) DESC, l_orderkey, l_linenumber LIMIT 3
""")
def q_worst_predictions(spark, sf_dir):
    w = E.worst_predictions(line_predictions(spark, sf_dir), ["l_orderkey", "l_linenumber"])
    return w.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in
                                                    ["label", "prediction", "residual", "abs_error"]], "in_band")


@query("residual_summary", f"""
SELECT CAST(count(r) AS BIGINT) AS n, round(avg(r), 4) + 0.0 AS mean, round(stddev_pop(r), 6) AS std,
       round(skewness(r), 6) AS skew, round(kurtosis(r), 6) AS kurtosis
FROM (SELECT label - prediction AS r FROM {LINE_SQL} p) t
""")
def q_residual_summary(spark, sf_dir):
    s = E.residual_summary(line_predictions(spark, sf_dir))
    return s.withColumn("mean", F.round(F.col("mean"), 4) + F.lit(0.0))


def _residual_hist_sql(bins):
    from tabsight.plans.catalog_profile import _hist_sql
    return _hist_sql(f"(SELECT label - prediction AS residual FROM {LINE_SQL} p)", "residual", bins)


@query("residual_histogram", _residual_hist_sql(35))
def q_residual_histogram(spark, sf_dir):
    return P.histogram(E.with_residual(line_predictions(spark, sf_dir)), "residual", 35)


@query("union_results", f"""
WITH {CC_SQL}
SELECT model, accuracy, f1_weighted, CAST(NULL AS DOUBLE) AS r2, CAST(NULL AS DOUBLE) AS rmse FROM scores
UNION ALL
SELECT 'line_fit', NULL, NULL,
       round(1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(label)), 4),
       round(sqrt(sum((label - prediction) ^ 2) / count(label)), 4) FROM {LINE_SQL} p
""")
def q_union_results(spark, sf_dir):
    cls = rule_scores(spark, sf_dir)
    reg = E.regression_scores(line_predictions(spark, sf_dir)).select(
        F.lit("line_fit").alias("model"), "r2", "rmse")
    return union_all_by_name(cls, reg)


@query("residual_density", f"""
WITH v AS (SELECT label - prediction AS r FROM {LINE_SQL} p),
s AS (SELECT count(r) AS n, min(r) AS lo, max(r) AS hi, stddev_samp(r) AS sd FROM v),
g AS (SELECT CAST(range AS INTEGER) AS point FROM range(300)),
q AS (SELECT point, lo + point * ((hi - lo) / 299) AS x, n, sd * pow(n, -0.2) AS h FROM g, s),
k AS (SELECT point, x, sum(exp(-0.5 * pow((x - r) / h, 2))) / (n * h * sqrt(2 * pi())) AS density FROM q, v GROUP BY point, x, n, h),
t AS (SELECT max(c) AS top FROM (SELECT least(floor((r - lo) * 35 / (hi - lo)), 34) AS b, count(*) AS c FROM v, s GROUP BY 1) u)
SELECT point, round(x, 6) AS x, round(density, 8) AS density, round(density * top / max(density) OVER (), 4) AS scaled FROM k, t
""")
def q_residual_density(spark, sf_dir):
    """KDE of residuals scaled to the tallest 35-bin histogram bar."""
    return D.scaled_density(E.with_residual(line_predictions(spark, sf_dir)), "residual", 300, 35)
