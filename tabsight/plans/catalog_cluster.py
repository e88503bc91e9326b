"""Phase 6 queries: cluster quality, k-means, mixtures, PCA/SVD projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import cluster as K
from tabsight.plans.registry import query, table
from tabsight.sources.io import union_all_by_name

GMM_PCA = 20  # components for the mixture: 64 dimensions exceed small tables' rows
EMB = """(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query("silhouette_by_label", f"""
WITH e AS {EMB},
cs AS (SELECT label, count(*) AS n FROM e GROUP BY label),
p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.v, b.v) ^ 2) AS ss
      FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
m AS (SELECT p.vec_id, la, lb, CASE WHEN la = lb THEN ss / (cs.n - 1) ELSE ss / cs.n END AS md
      FROM p JOIN cs ON cs.label = p.lb),
ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
       FROM m GROUP BY 1),
s AS (SELECT CASE WHEN cs.n <= 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END AS s
      FROM e JOIN cs USING (label) LEFT JOIN ab ON ab.vec_id = e.vec_id)
SELECT round(avg(s), 6) AS silhouette, CAST((SELECT count(*) FROM cs) AS INTEGER) AS n_clusters FROM s
""")
def q_silhouette_by_label(spark, sf_dir):
    """Squared-Euclidean silhouette of the given labels (closed form; the
    oracle computes it from all pairs)."""
    s = K.silhouette_sq(embeddings(spark, sf_dir), "embedding", "label")
    return s.select(F.round("silhouette", 6).alias("silhouette"), F.col("n_clusters").cast("int"))


@query("silhouette_euclidean_by_label", f"""
WITH e AS {EMB},
cs AS (SELECT label, count(*) AS n FROM e GROUP BY label),
p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.v, b.v)) AS ss
      FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
m AS (SELECT p.vec_id, la, lb, CASE WHEN la = lb THEN ss / (cs.n - 1) ELSE ss / cs.n END AS md
      FROM p JOIN cs ON cs.label = p.lb),
ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
       FROM m GROUP BY 1),
s AS (SELECT CASE WHEN cs.n <= 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END AS s
      FROM e JOIN cs USING (label) LEFT JOIN ab ON ab.vec_id = e.vec_id)
SELECT round(avg(s), 6) AS silhouette, CAST((SELECT count(*) FROM cs) AS INTEGER) AS n_clusters FROM s
""")
def q_silhouette_euclidean_by_label(spark, sf_dir):
    """Euclidean silhouette of the given labels, every row against its own
    cluster and those that could be nearest."""
    from tabsight.operators.silhouette import silhouette
    s = silhouette(embeddings(spark, sf_dir), "embedding", "label")
    return s.select(F.round("silhouette", 6).alias("silhouette"), F.col("n_clusters").cast("int"))


@query("davies_bouldin_by_label", f"""
WITH e AS {EMB},
u AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e),
c AS (SELECT label, list(m ORDER BY i) AS mu FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2) t GROUP BY label),
s AS (SELECT e.label, avg(list_distance(e.v, c.mu)) AS s FROM e JOIN c USING (label) GROUP BY e.label),
r AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.mu, b.mu)) AS r
      FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label
      GROUP BY a.label)
SELECT round(avg(r), 6) AS davies_bouldin, CAST((SELECT count(*) FROM c) AS INTEGER) AS n_clusters FROM r
""")
def q_davies_bouldin_by_label(spark, sf_dir):
    s = K.davies_bouldin(embeddings(spark, sf_dir), "embedding", "label")
    return s.select(F.round("davies_bouldin", 6).alias("davies_bouldin"), F.col("n_clusters").cast("int"))


def _k(spark, sf_dir):
    return K.cluster_count(embeddings(spark, sf_dir).count())


def prepared(spark, sf_dir):
    """The embeddings standardised column by column, as the original clusters."""
    return K.standardize_vector(embeddings(spark, sf_dir), "embedding", "z").drop("embedding").withColumnRenamed("z", "embedding")


@query("kmeans")
def q_kmeans(spark, sf_dir):
    """Standardised rows, k = min(5, max(2, n // 50)); best of 5 seeded starts."""
    _, out = K.kmeans(prepared(spark, sf_dir), "embedding", _k(spark, sf_dir))
    return out.select("vec_id", "cluster")


@query("gmm")
def q_gmm(spark, sf_dir):
    """Gaussian mixture on the standardised embeddings projected to
    ``GMM_PCA`` components (a parameter of this query)."""
    _, out = K.gaussian_mixture(prepared(spark, sf_dir), "embedding", _k(spark, sf_dir), pca_dim=GMM_PCA)
    return out.select("vec_id", "cluster", F.round("probability", 6).alias("probability"))


@query("elbow")
def q_elbow(spark, sf_dir):
    """Standardised rows, best of 5 starts for each k."""
    return K.elbow(prepared(spark, sf_dir), "embedding", 10)


@query("pca_scree")
def q_pca_scree(spark, sf_dir):
    return K.pca_scree(embeddings(spark, sf_dir), "embedding", 20)


def _pca2(spark, sf_dir):
    """(points with x and y, share of the variance the two axes keep)"""
    from pyspark.ml.functions import vector_to_array
    p, share = K.pca_project(embeddings(spark, sf_dir), "embedding", 2, out="p", with_share=True)
    return p.select("vec_id", "label", vector_to_array("p")[0].alias("x"), vector_to_array("p")[1].alias("y")), share


@query("projection")
def q_projection(spark, sf_dir):
    """PCA and truncated SVD (2-D) side by side, one row per (method, id),
    with the percentage of variance the two axes keep."""
    pca, p_share = _pca2(spark, sf_dir)
    svd, s_share = K.svd_project(embeddings(spark, sf_dir), "embedding", 2)
    pca = pca.select(F.lit("pca").alias("method"), "vec_id", "label", "x", "y", F.lit(p_share).alias("share"))
    svd = svd.select(F.lit("svd").alias("method"), "vec_id", "label", F.col("c1").alias("x"), F.col("c2").alias("y"),
                     F.lit(s_share).alias("share"))
    return union_all_by_name(pca, svd).select("method", "vec_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
                                              F.round(F.col("share") * 100, 2).alias("variance_pct"))


@query("cluster_map")
def q_cluster_map(spark, sf_dir):
    """2-D PCA points with their k-means cluster, its centroid and size."""
    pts, _ = _pca2(spark, sf_dir)
    _, km = K.kmeans(prepared(spark, sf_dir), "embedding", _k(spark, sf_dir))
    j = pts.join(km.select("vec_id", "cluster"), "vec_id")
    cent = K.cluster_sizes_centroids(j, "cluster")
    return j.join(cent, "cluster").select("vec_id", "cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
                                          F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "size")


@query("cluster_leaderboard")
def q_cluster_leaderboard(spark, sf_dir):
    """k-means, Gaussian mixture and DBSCAN (eps 0.5, 5 points) scored by
    silhouette (squared) and Davies–Bouldin on the standardised rows;
    clusterings with fewer than two clusters besides noise score −1 / 999 and
    are dropped; best by silhouette; DB also as a share of the largest."""
    from pyspark.sql import Window
    emb = prepared(spark, sf_dir)
    k = _k(spark, sf_dir)
    rows = []
    from tabsight.operators.dbscan import dbscan

    def fit_dbscan(df, vec, _k):
        lab = dbscan(df, "vec_id", vec, 0.5, 5)
        return None, df.join(lab, "vec_id")

    def fit_mixture(df, vec, k):
        return K.gaussian_mixture(df, vec, k, pca_dim=GMM_PCA)

    for name, fit in (("kmeans", K.kmeans), ("gaussian_mixture", fit_mixture), ("dbscan", fit_dbscan)):
        try:
            _, lab = fit(emb, "embedding", k)
            s = K.silhouette_sq(lab, "embedding", "cluster", noise=-1).first()
            db = K.davies_bouldin(lab, "embedding", "cluster", noise=-1).first()
            rows.append((name, float(s["silhouette"]), float(db["davies_bouldin"]), int(s["n_clusters"]), None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, None, None, None, f"{type(e).__name__}: {e}"[:300]))
    lb = spark.createDataFrame(rows, "method string, silhouette double, davies_bouldin double, n_clusters int, error string")
    lb = lb.where(F.col("silhouette").isNull() | (F.col("silhouette") > -1))
    w = Window.orderBy(F.desc_nulls_last("silhouette"), "method")  # one row per method
    mx = lb.agg(F.max("davies_bouldin").alias("__m"))
    return (lb.crossJoin(mx).withColumn("rank", F.row_number().over(w))
            .select("method", F.round("silhouette", 6).alias("silhouette"),
                    F.round("davies_bouldin", 6).alias("davies_bouldin"),
                    F.round(F.try_divide(F.col("davies_bouldin"), F.col("__m")), 6).alias("db_share_of_max"),
                    "n_clusters", (F.col("rank") == 1).alias("best"), "error"))


def events_2d(spark, sf_dir):
    """events as standardised (value, fractional hour of day) points."""
    from tabsight.operators.features import standardize
    ev = table(spark, sf_dir, "events")
    h = F.hour("ts") + F.minute("ts") / 60.0 + F.second("ts") / 3600.0
    pts = ev.select("event_id", F.col("value").cast("double").alias("value"), h.cast("double").alias("hour"))
    z = standardize(pts, ["value", "hour"])
    return z.select("event_id", F.array("value", "hour").alias("v"))


@query("dbscan")
def q_dbscan(spark, sf_dir):
    """DBSCAN (eps 0.5, 5 points) over every event; noise = −1.  Checked
    against brute force in the tests."""
    from tabsight.operators.dbscan import dbscan
    return dbscan(events_2d(spark, sf_dir), "event_id", "v", 0.5, 5)
