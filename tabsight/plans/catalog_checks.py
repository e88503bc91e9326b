"""Properties of operators that SQL cannot recompute, checked on whole tables:
each query returns one row per item with the property's truth, and its SQL the
items it must hold for."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsight.operators import cluster as K
from tabsight.plans.catalog_cluster import _k, prepared
from tabsight.plans.catalog_report import HELD_OUT_SQL
from tabsight.plans.catalog_series import HOURLY_SQL, hourly
from tabsight.plans.catalog_text import tfidf_sql
from tabsight.plans.registry import query, table
from tabsight.session import checkpoint_dir


@query("save_load_check", f"SELECT doc_id, true AS same FROM {HELD_OUT_SQL} t")
def q_save_load_check(spark, sf_dir):
    """Scaler and classifier saved as one pipeline and loaded again
    give the same prediction and probability for every held-out document."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array
    from tabsight.plans.catalog_models import _prep_cls
    from tabsight.sources.io import load_model, save_model
    pc = _prep_cls(spark, sf_dir)
    model = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="__z", withMean=True),
                             LogisticRegression(featuresCol="__z", maxIter=100)]).fit(pc.train)
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    save_model(model, path)
    one, two = (m.transform(pc.test).select(pc.id_col, "prediction", vector_to_array("probability").alias("p"))
                for m in (model, load_model(path)))
    two = two.withColumnsRenamed({"prediction": "prediction_2", "p": "p_2"})
    return one.join(two, pc.id_col).select("doc_id", ((F.col("prediction") == F.col("prediction_2")) & (F.col("p") == F.col("p_2"))).alias("same"))


@query("forecast_shape", f"""
WITH h AS {HOURLY_SQL}, n AS (SELECT event_type, count(*) AS n FROM h GROUP BY event_type)
SELECT event_type, method, n - CAST(floor(0.8 * n) AS BIGINT) AS steps, n - CAST(floor(0.8 * n) AS BIGINT) AS forecasts
FROM n, (SELECT unnest(['least squares', 'likelihood']) AS method)
""")
def q_forecast_shape(spark, sf_dir):
    """Both ARIMA fits forecast every held-out hour of every series."""
    from tabsight.operators.arima_ml import arima_ml_forecast
    from tabsight.operators.forecast import arima_forecast
    h = hourly(spark, sf_dir)
    parts = [f(h, ["event_type"], "ts", "value", 2, 2, 0.8, id_col="ts").select("event_type", "step", "forecast", F.lit(m).alias("method"))
             for m, f in (("least squares", arima_forecast), ("likelihood", arima_ml_forecast))]
    return parts[0].unionByName(parts[1]).groupBy("event_type", "method").agg(
        F.count_distinct("step").alias("steps"), F.count("forecast").alias("forecasts"))


@query("isolation_check", "SELECT count(*) AS n_rows, true AS scores_in_range, true AS share_near FROM events")
def q_isolation_check(spark, sf_dir):
    """Every event has a score between 0 and 1, and about the wanted
    5 % are flagged (ties at the threshold are not)."""
    from tabsight.operators.anomaly import isolation_forest
    f = isolation_forest(table(spark, sf_dir, "events"), "event_id", ["user_id", "value"])
    return f.agg(F.count_distinct("event_id").alias("n_rows"), F.min((F.col("score") > 0) & (F.col("score") < 1)).alias("scores_in_range"),
                 F.avg(F.col("is_anomaly").cast("int")).between(0.03, 0.051).alias("share_near"))


@query("kmeans_check", "SELECT vec_id, true AS nearest FROM embeddings")
def q_kmeans_check(spark, sf_dir):
    """Every row is in the cluster whose centre is nearest."""
    m, out = K.kmeans(prepared(spark, sf_dir), "embedding", _k(spark, sf_dir))
    x = K.to_array(out, "embedding", "x")
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(m.centres)], "c int, centre array<double>")
    gap = F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    each = x.join(F.broadcast(centres)).groupBy("vec_id", "cluster").agg(  # at most 5 centres
        F.min(gap).alias("least"), F.min(F.when(F.col("c") == F.col("cluster"), gap)).alias("own"))
    return each.select("vec_id", (F.col("own") <= F.col("least") * (1 + 1e-9)).alias("nearest"))


@query("elbow_check", """
SELECT CAST(range AS INTEGER) AS k, true AS not_above_total
FROM range(2, (SELECT CAST(least(10, count(*) // 2 + 1) AS BIGINT) FROM embeddings) + 1)
""")
def q_elbow_check(spark, sf_dir):
    """An inertia for every k, none above the one cluster's (n rows of d
    standardised columns: n * d), and none above that of one cluster less."""
    from pyspark.sql import Window
    rows = prepared(spark, sf_dir)
    n, d = rows.count(), len(rows.first()["embedding"])
    before = F.lag("inertia", 1, float(n * d) * (1 + 1e-9)).over(Window.orderBy("k"))  # at most 9 rows
    return K.elbow(rows, "embedding", 10).select("k", (F.col("inertia") <= before * 1.001).alias("not_above_total"))


@query("pca_check", """
SELECT CAST(range AS INTEGER) AS component, true AS in_order
FROM range(1, least(20, (SELECT count(*) FROM embeddings), (SELECT max(len(embedding)) FROM embeddings)) + 1)
""")
def q_pca_check(spark, sf_dir):
    """Variance shares descend, their running sum is theirs and at most 1."""
    from pyspark.sql import Window
    t = K.pca_scree(table(spark, sf_dir, "embeddings"), "embedding", 20)
    w = Window.orderBy("component")  # at most 20 rows
    total = F.sum("variance_ratio").over(w.rowsBetween(Window.unboundedPreceding, 0))
    fits = F.abs(total - F.col("cumulative")) < 1e-4
    return t.select("component", ((F.col("variance_ratio") <= F.lag("variance_ratio", 1, 1.0).over(w)) & fits
                                  & (F.col("cumulative") <= 1.000001)).alias("in_order"))


@query("tfidf_own_stop_words", lambda: tfidf_sql(OWN_STOP_WORDS))
def q_tfidf_own_stop_words(spark, sf_dir):
    """X3 with a stop list of one's own."""
    from tabsight.operators.text import tfidf_long
    return tfidf_long(table(spark, sf_dir, "documents"), "doc_id", "text", 300, stop_words=OWN_STOP_WORDS)


OWN_STOP_WORDS = ("the", "of", "and", "le", "la", "les", "der", "die", "das", "el", "los")


@query("importance_check", "SELECT CAST(range AS INTEGER) AS rank, true AS in_order FROM range(1, 1 + least(5, (SELECT count(*) FROM lineitem)))")
def q_importance_check(spark, sf_dir):
    """Importances of the five features of the regression problem
    descend, and the running share is theirs and ends at 1."""
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.sql import Window
    from tabsight.operators import models as M
    from tabsight.plans.catalog_models import _prep_reg
    pr = _prep_reg(spark, sf_dir)
    m = DecisionTreeRegressor(maxDepth=8, seed=M.SEED).fit(pr.train)
    t = M.feature_importance(m, pr.feature_cols, 20, spark=spark)
    w = Window.orderBy("rank")  # one row per feature
    running = F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.col("rank") < len(pr.feature_cols)
    return t.select("rank", ((F.col("importance") <= F.lag("importance", 1, 1.0).over(w)) & (F.abs(running - F.col("cumulative_share")) < 1e-4)
                             & (last | (F.abs(F.col("cumulative_share") - 1) < 1e-4))).alias("in_order"))


@query("projection_check", """
SELECT method, count(*) AS n_rows, true AS strongest_first
FROM embeddings, (SELECT unnest(['pca', 'svd']) AS method) GROUP BY method
""")
def q_projection_check(spark, sf_dir):
    """Both projections give every row two coordinates, the first
    with at least the second moment of the other."""
    from tabsight.plans.catalog_cluster import q_projection
    p = q_projection(spark, sf_dir)
    return p.groupBy("method").agg(F.count_distinct("vec_id").alias("n_rows"),
                                   (F.sum(F.col("x") * F.col("x")) >= F.sum(F.col("y") * F.col("y")) * (1 - 1e-9)).alias("strongest_first"))


@query("cluster_map_check", "SELECT count(*) AS n_rows, true AS sizes_fit, true AS centres_fit FROM embeddings")
def q_cluster_map_check(spark, sf_dir):
    """Every row is on the map once, with the size and the mean
    position of its cluster."""
    from tabsight.plans.catalog_cluster import q_cluster_map
    m = q_cluster_map(spark, sf_dir)
    own = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    each = m.join(own, "cluster")
    near = (F.abs(F.col("cx") - F.col("ax")) < 1e-4) & (F.abs(F.col("cy") - F.col("ay")) < 1e-4)
    return each.agg(F.count_distinct("vec_id").alias("n_rows"), F.min(F.col("size") == F.col("n")).alias("sizes_fit"),
                    F.min(near).alias("centres_fit"))
