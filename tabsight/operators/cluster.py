"""Clustering, projection and cluster quality.

Inputs are a DataFrame with an id column and a vector column (``VectorUDT``)
or a numeric array column.  Fits are Spark ML estimators; quality measures
are closed forms over per-cluster sums, so no pairwise distances are
materialised:

* squared-Euclidean silhouette (Spark's ``ClusteringEvaluator`` definition):
  mean squared distance from x to cluster C is
  (n_C·‖x‖² − 2·x·S_C + Q_C) / n_C with S_C = Σ y, Q_C = Σ ‖y‖²;
* Davies–Bouldin from centroids and mean centroid distances.

Sums are taken around one of the rows, so data far from zero does not cancel.  The per-cluster table (k rows × d numbers, k ≤ ``max_clusters``, a
documented bound whose breach is an error) is the only thing brought to the
driver; nothing of size k × k is kept.  A ``noise`` label is not a cluster: with
fewer than two real clusters the scores are −1 and 999, otherwise noise rows
are scored like a group of their own (as in the original).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CLUSTERS = 10_000
CELLS = 1 << 22  # numbers in one block of a distance matrix


def to_vector(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import VectorUDT
    if isinstance(df.schema[col].dataType, VectorUDT):
        return df.withColumn(out, F.col(col)) if out != col else df
    return df.withColumn(out, array_to_vector(F.transform(F.col(col), lambda x: x.cast("double"))))


def to_array(df: DataFrame, col: str, out: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT
    if isinstance(df.schema[col].dataType, VectorUDT):
        return df.withColumn(out, vector_to_array(F.col(col)))
    return df.withColumn(out, F.transform(F.col(col), lambda x: x.cast("double")))


def cluster_count(n: int) -> int:
    """Fixed values 5, 2, 50: k = min(5, max(2, n // 50))."""
    return min(5, max(2, n // 50))


def _cluster_table(df: DataFrame, arr: str, label: str, max_clusters: int = MAX_CLUSTERS):
    """(centre, labels, n, S (k×d), Q (k)): per-cluster sums of the rows minus
    the first row found, which takes away an offset common to all rows."""
    first = df.select(arr).where(F.col(arr).isNotNull()).first()
    dim = len(first[0]) if first else 0
    mean = [0.0 if v is None or v != v else v for v in first[0]] if first else []
    x = [F.col(arr)[i] - F.lit(float(mean[i])) for i in range(dim)]
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                              F.array(*[F.sum(c) for c in x]).alias("s"),
                              F.sum(sum((c * c for c in x), F.lit(0.0))).alias("q"))
    rows = g.limit(max_clusters + 1).collect()
    if len(rows) > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters")
    rows.sort(key=lambda r: (r[label] is None, r[label]))
    labels = [r[label] for r in rows]
    return np.array(mean, float), labels, np.array([r["n"] for r in rows], "float64"), \
        np.array([r["s"] for r in rows], "float64"), np.array([r["q"] for r in rows], "float64")


def _real(labels: list, noise) -> int:
    return sum(1 for lab in labels if lab != noise)


def silhouette_sq(df: DataFrame, vec: str, label: str, by_point: bool = False, noise=None):
    """Mean silhouette with squared Euclidean distance; a one-member cluster
    scores 0; fewer than two clusters besides ``noise`` → -1.  No pairs."""
    arr = "__arr"
    d = to_array(df, vec, arr).select(label, arr)
    centre, labels, n, S, Q = _cluster_table(d, arr, label)
    spark = df.sparkSession
    k_real = _real(labels, noise)
    if k_real < 2:
        return spark.createDataFrame([(-1.0, k_real)], "silhouette double, n_clusters int")
    index = {lab: i for i, lab in enumerate(labels)}
    lt = d.schema[label].dataType.simpleString()
    step = max(1, CELLS // len(labels))

    def scores(X, own):
        X = X - centre
        D = ((X * X).sum(axis=1)[:, None] * n[None, :] - 2 * X @ S.T + Q[None, :])
        rows = np.arange(len(X))
        a_den = n[own] - 1
        a = np.where(a_den > 0, D[rows, own] / np.maximum(a_den, 1), 0.0)
        other = D / n[None, :]
        other[rows, own] = np.inf
        bmin = other.min(axis=1)
        m = np.maximum(a, bmin)
        return np.where((a_den > 0) & (m > 0), (bmin - a) / np.where(m > 0, m, 1), 0.0)

    def run(batches):
        for b in batches:
            if len(b) == 0:
                continue
            X = np.stack(b[arr].to_numpy()).astype("float64")
            own = np.array([index[v] for v in b[label]])
            s = np.concatenate([scores(X[at:at + step], own[at:at + step]) for at in range(0, len(X), step)])
            yield pd.DataFrame({label: b[label], "s": s})

    per = d.mapInPandas(run, f"{label} {lt}, s double")
    if by_point:
        return per
    return per.agg(F.avg("s").alias("silhouette"), F.lit(k_real).alias("n_clusters"))


def davies_bouldin(df: DataFrame, vec: str, label: str, noise=None):
    """Davies–Bouldin index (Euclidean); 999 when fewer than two clusters
    besides ``noise``.  Centroid distances are taken for a block of clusters
    at a time."""
    arr = "__arr"
    d = to_array(df, vec, arr).select(label, arr)
    centre, labels, n, S, _ = _cluster_table(d, arr, label)
    spark = df.sparkSession
    k_real = _real(labels, noise)
    if k_real < 2:
        return spark.createDataFrame([(999.0, k_real)], "davies_bouldin double, n_clusters int")
    C = S / n[:, None]
    index = {lab: i for i, lab in enumerate(labels)}
    lt = d.schema[label].dataType.simpleString()

    def run(batches):
        for b in batches:
            if len(b) == 0:
                continue
            X = np.stack(b[arr].to_numpy()).astype("float64") - centre
            own = np.array([index[v] for v in b[label]])
            yield pd.DataFrame({label: b[label], "dist": np.sqrt(((X - C[own]) ** 2).sum(axis=1))})

    spread = dict(d.mapInPandas(run, f"{label} {lt}, dist double").groupBy(label)
                  .agg(F.avg("dist")).collect())  # ≤ k rows
    s = np.array([spread[lab] for lab in labels])
    step = max(1, CELLS // (len(labels) * max(1, C.shape[1])))
    worst = []
    for at in range(0, len(labels), step):
        part = np.sqrt(((C[at:at + step, None, :] - C[None, :, :]) ** 2).sum(axis=2))
        part[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
        with np.errstate(divide="ignore"):
            worst.append(((s[at:at + step, None] + s[None, :]) / part).max(axis=1))
    return spark.createDataFrame([(float(np.concatenate(worst).mean()), k_real)], "davies_bouldin double, n_clusters int")


def kmeans(df: DataFrame, vec: str, k: int, starts: int = 5, seed: int = 42, out: str = "cluster"):
    """Best of ``starts`` seeded k-means++ runs by inertia, all in the same
    passes -> (model, labelled df)."""
    from tabsight.operators.kmeans_batch import Centres, batched_kmeans
    model = Centres(min(batched_kmeans(df, vec, [k], starts, seed), key=lambda r: r.inertia), vec, out)
    return model, model.transform(df)


def gaussian_mixture(df: DataFrame, vec: str, k: int, seed: int = 42, pca_dim: int | None = None,
                     out: str = "cluster"):
    """Full-covariance Gaussian mixture → (model, labelled df).  ``pca_dim``
    (off unless given) first projects the centred rows on that many principal
    components: with fewer rows than dimensions a full covariance is not
    positive definite."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array
    d = to_vector(df, vec, "__v")
    if pca_dim:
        d = pca_project(d, "__v", pca_dim, out="__p", standardize=False).drop("__v").withColumnRenamed("__p", "__v")
    m = GaussianMixture(k=k, seed=seed, featuresCol="__v", predictionCol=out, probabilityCol="__prob").fit(d)
    res = m.transform(d).withColumn("probability", F.array_max(vector_to_array("__prob"))).drop("__v", "__prob")
    return m, res


def elbow(df: DataFrame, vec: str, k_max: int = 10, seed: int = 42, starts: int = 5) -> DataFrame:
    """Lowest k-means inertia of ``starts`` seeded runs for k = 2 …
    min(k_max, n // 2 + 1); all runs share their passes over the rows."""
    from tabsight.operators.kmeans_batch import batched_kmeans
    best: dict[int, float] = {}
    for r in batched_kmeans(df, vec, list(range(2, min(k_max, df.count() // 2 + 1) + 1)), starts, seed):
        best[r.k] = min(r.inertia, best.get(r.k, r.inertia))
    return df.sparkSession.createDataFrame(list(best.items()), "k int, inertia double")


def standardize_vector(df: DataFrame, vec: str, out: str) -> DataFrame:
    """Population standardisation of a vector column (Spark's scaler divides
    by the n−1 std: rescale by √((n−1)/n))."""
    from pyspark.ml.feature import StandardScaler
    d = to_vector(df, vec, "__sv_in")
    n = d.count()
    m = StandardScaler(inputCol="__sv_in", outputCol="__sv", withMean=True, withStd=True).fit(d)
    from pyspark.ml.functions import array_to_vector, vector_to_array
    f = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
    return (m.transform(d).withColumn(out, array_to_vector(F.transform(vector_to_array("__sv"), lambda x: x * f)))
            .drop("__sv_in", "__sv"))


def pca_fit(df: DataFrame, vec: str, k: int):
    from pyspark.ml.feature import PCA
    return PCA(k=k, inputCol=vec, outputCol="__pca").fit(df)


def pca_project(df: DataFrame, vec: str, k: int, out: str = "pca", standardize: bool = True,
                with_share: bool = False):
    """Centre (and standardise) first: Spark's PCA does not centre on
    transform.  ``with_share``: also the share of variance the ``k`` axes keep."""
    d = to_vector(df, vec, "__pv")
    if standardize:
        d = standardize_vector(d, "__pv", "__pc")
    else:
        from pyspark.ml.feature import StandardScaler
        d = StandardScaler(inputCol="__pv", outputCol="__pc", withMean=True, withStd=False).fit(d).transform(d)
    m = pca_fit(d, "__pc", k)
    res = m.transform(d).withColumnRenamed("__pca", out).drop("__pv", "__pc")
    return (res, float(m.explainedVariance.toArray().sum())) if with_share else res


def pca_scree(df: DataFrame, vec: str, k_max: int = 20, digits: int = 6) -> DataFrame:
    """Explained variance per component (up to min(k_max, d, n)), running
    share and the first component reaching 80 % and 95 %."""
    d = standardize_vector(to_vector(df, vec, "__in"), "__in", "__z").select("__z").persist()
    n = d.count()
    dim = d.first()[0].size
    k = max(1, min(k_max, dim, n))
    ev = pca_fit(d, "__z", k).explainedVariance.toArray().tolist()
    d.unpersist()
    spark = df.sparkSession
    t = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ev)], "component int, variance_ratio double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)  # ≤ 20 rows
    t = t.withColumn("cumulative", F.sum("variance_ratio").over(w))
    reach = t.agg(F.coalesce(F.min(F.when(F.col("cumulative") >= 0.8, F.col("component"))), F.max("component")).alias("n80"),
                  F.coalesce(F.min(F.when(F.col("cumulative") >= 0.95, F.col("component"))), F.max("component")).alias("n95"))
    return t.crossJoin(reach).select("component", F.round("variance_ratio", digits).alias("variance_ratio"),
                                     F.round("cumulative", digits).alias("cumulative"),
                                     (F.col("component") == F.col("n80")).alias("reaches_80"),
                                     (F.col("component") == F.col("n95")).alias("reaches_95"))


def svd_project(df: DataFrame, vec: str, k: int = 2, standardize: bool = True) -> tuple[DataFrame, float]:
    """Truncated SVD (no centring beyond the optional standardisation):
    rows projected on the top ``k`` right singular vectors as c1 …, plus the
    share of total variance the projected columns keep."""
    from tabsight.operators.svd import project, randomized_svd
    d = to_vector(df, vec, "__sv0")
    d = standardize_vector(d, "__sv0", "__sx") if standardize else d.withColumn("__sx", F.col("__sv0"))
    found = randomized_svd(d, "__sx", k)
    names = [f"c{j + 1}" for j in range(found.v.shape[1])]
    proj = project(d, "__sx", found.v, names).drop("__sv0", "__sx")
    kept = sum(v or 0.0 for v in proj.agg(*[F.var_samp(c) for c in names]).first())
    return proj, float(kept / found.variance) if found.variance > 0 else float("nan")


def cluster_sizes_centroids(points: DataFrame, label: str, x: str = "x", y: str = "y") -> DataFrame:
    """Size and mean 2-D position per label (noise −1 kept separately)."""
    return points.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("size"),
                                     F.avg(x).alias("cx"), F.avg(y).alias("cy"))
