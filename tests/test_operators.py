"""Property, parity and edge tests for the operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet")


# ---------------------------------------------------------------- ordered windows
def test_chunked_rank_equals_window(spark):
    from tabsight.operators.ordered import RANK, ordered_rank
    ev = events(spark)
    got = ordered_rank(ev, ["event_type"], "ts", ["event_id"], partitions=17).select("event_id", RANK)
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    want = ev.select("event_id", F.row_number().over(w).alias(RANK))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_chunked_rolling_equals_window(spark):
    from tabsight.operators.series import rolling_stats
    ev = events(spark)
    got = rolling_stats(ev, ["event_type"], "ts", "value", 7, "event_id", block_rows=23, partitions=9)
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-6, 0)
    want = ev.select("*", F.round(F.when(F.count("value").over(w) == 7, F.avg("value").over(w)), 6).alias("ma"),
                     F.round(F.when(F.count("value").over(w) == 7, F.stddev_samp("value").over(w)), 6).alias("std"))
    a = {r["event_id"]: (r["ma"], r["std"]) for r in got.collect()}
    b = {r["event_id"]: (r["ma"], r["std"]) for r in want.collect()}
    assert a == b


def test_rolling_matches_pandas(spark):
    from tabsight.operators.series import rolling_stats
    ev = events(spark)
    got = rolling_stats(ev, [], "ts", "value", 30, "event_id").orderBy("ts", "event_id").toPandas()
    pdf = ev.orderBy("ts", "event_id").toPandas()
    ma = pdf["value"].rolling(30).mean().round(6)
    sd = pdf["value"].rolling(30).std().round(6)
    assert np.allclose(got["ma"].astype(float), ma, equal_nan=True, atol=1e-6)
    assert np.allclose(got["std"].astype(float), sd, equal_nan=True, atol=1e-6)


def test_lags_and_time_split(spark):
    from tabsight.operators.series import add_lags, time_split
    ev = events(spark)
    lag = add_lags(ev, ["event_type"], "ts", "value", 2, "event_id", block_rows=11, partitions=13)
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    want = ev.select("event_id", F.lag("value", 2).over(w).alias("lag_2"))
    assert lag.select("event_id", "lag_2").exceptAll(want).count() == 0
    sp = time_split(ev, ["event_type"], "ts", "event_id", 0.8, partitions=19)
    per = sp.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("split") == "train").cast("int")).alias("t"))
    for r in per.collect():
        assert r["t"] == math.floor(r["n"] * 0.8)


# ---------------------------------------------------------------- pandas parity
def test_describe_matches_pandas(spark):
    from tabsight.operators.profile import describe_numeric
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    got = {r["column"]: r for r in describe_numeric(li, cols).collect()}
    pdf = li.select(*cols).toPandas().describe().round(2)
    for c in cols:
        assert got[c]["mean"] == pytest.approx(pdf.loc["mean", c], abs=0.011)
        assert got[c]["std"] == pytest.approx(pdf.loc["std", c], abs=0.011)
        assert got[c]["p50"] == pytest.approx(pdf.loc["50%", c], abs=0.011)


def test_quartile_bins_match_qcut(spark):
    from tabsight.operators.features import quartile_bins
    p = spark.read.parquet(f"{SF_SMALL}/part.parquet").select("p_partkey", "p_size")
    got = quartile_bins(p, ["p_size"]).orderBy("p_partkey").toPandas()
    want = pd.qcut(got["p_size"], q=4, labels=False, duplicates="drop")
    assert (got["p_size_bin"].to_numpy() == want.to_numpy()).all()


def test_skew_kurt_match_pandas(spark):
    from tabsight.operators.evaluate import residual_summary
    ev = events(spark).select(F.col("value").alias("label"), F.lit(0.0).alias("prediction"))
    got = residual_summary(ev).first()
    s = ev.toPandas()["label"]
    assert got["skew"] == pytest.approx(s.skew(), rel=1e-6)
    assert got["kurtosis"] == pytest.approx(s.kurt(), rel=1e-6)


# ---------------------------------------------------------------- edge cases
def test_constant_column(spark):
    from tabsight.operators.features import standardize
    from tabsight.operators.outliers import remove_z_outliers
    from tabsight.operators.profile import correlation_matrix, histogram
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(10)], "id long, c double, x double")
    assert remove_z_outliers(df, ["c"]).count() == 10
    assert correlation_matrix(df, ["c", "x"]).first()["corr"] is None
    assert {r["c"] for r in standardize(df, ["c"]).collect()} == {0.0}
    h = histogram(df, "c", 40).where("count > 0").collect()
    assert len(h) == 1 and h[0]["bin"] == 20 and h[0]["count"] == 10


def test_nan_and_null_are_missing(spark):
    from tabsight.operators.profile import missing_report, profile_columns
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "id long, x double")
    r = missing_report(df).collect()
    assert [(x["column"], x["n_missing"]) for x in r] == [("x", 2)]
    p = {x["column"]: x for x in profile_columns(df).collect()}
    assert p["x"]["n_distinct"] == 1 and p["x"]["non_null"] == 1


def test_accented_words(spark):
    from tabsight.operators.text import top_words
    df = spark.createDataFrame([(1, "éabc abcé foo_bar Abc x1abc two-words")], "id long, t string")
    assert sorted(r["word"] for r in top_words(df, "t", 20).collect()) == ["abc", "two", "words"]


def test_parse_date_coercion(spark):
    from tabsight.operators.series import parse_date
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "x"), (3, None)], "id long, d string")
    got = {r["id"]: r["d"] for r in parse_date(df, "d").collect()}
    assert got[1] is not None and got[2] is None and got[3] is None


def test_one_row_and_empty(spark):
    from tabsight.operators.profile import dataset_summary, describe_numeric
    one = spark.createDataFrame([(1, 2.0)], "id long, x double")
    assert describe_numeric(one, ["x"]).first()["std"] is None
    empty = spark.createDataFrame([], "id long, x double")
    assert dataset_summary(empty).first()["n_rows"] == 0
    assert describe_numeric(empty, ["x"]).first()["count"] == 0


# ---------------------------------------------------------------- models / clusters
def _emb(spark):
    return spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")


def test_knn_equals_brute_force(spark):
    from tabsight.operators.features import train_test_split
    from tabsight.operators.knn import knn_neighbours
    e = train_test_split(_emb(spark), "vec_id")
    tr, te = e.where("split = 'train'"), e.where("split = 'test'")
    got = knn_neighbours(tr, te, "vec_id", "embedding", 5, n_pivots=7).toPandas()
    T = tr.select("vec_id", "embedding").toPandas()
    Q = te.select("vec_id", "embedding").toPandas()
    X = np.stack(T["embedding"]).astype("float64")
    for _, q in Q.iterrows():
        d = np.sqrt(((X - np.asarray(q["embedding"], "float64")) ** 2).sum(axis=1))
        order = np.lexsort((T["vec_id"].to_numpy(), d))[:5]
        want = list(T["vec_id"].to_numpy()[order])
        have = list(got[got["vec_id"] == q["vec_id"]].sort_values("rank")["neighbour_id"])
        assert have == want


def test_silhouette_closed_form_matches_pairs(spark):
    from tabsight.operators.cluster import silhouette_sq
    pdf = _emb(spark).toPandas()
    X = np.stack(pdf["embedding"]).astype("float64")
    lab = pdf["label"].to_numpy()
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(axis=2)
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        a = D[i, own].sum() / (own.sum() - 1) if own.sum() > 1 else 0.0
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append(0.0 if own.sum() <= 1 else (b - a) / max(a, b))
    got = silhouette_sq(_emb(spark), "embedding", "label").first()["silhouette"]
    assert got == pytest.approx(float(np.mean(s)), abs=1e-9)


def test_pca_scree_properties(spark):
    from tabsight.operators.cluster import pca_scree
    r = pca_scree(_emb(spark), "embedding", 20).orderBy("component").collect()
    v = [x["variance_ratio"] for x in r]
    assert all(a >= b - 1e-12 for a, b in zip(v, v[1:])) and sum(v) <= 1 + 1e-6
    assert sum(x["reaches_80"] for x in r) == 1


def test_isolation_forest_flags_about_five_percent(spark):
    from tabsight.operators.anomaly import isolation_forest
    f = isolation_forest(events(spark), "event_id", ["user_id", "value"], n_trees=50)
    share = f.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert 0.03 <= share <= 0.06


def test_kmeans_more_starts_not_worse(spark):
    from tabsight.operators.cluster import kmeans
    m1, _ = kmeans(_emb(spark), "embedding", 5, starts=1)
    m5, _ = kmeans(_emb(spark), "embedding", 5, starts=5)
    assert m5.summary.trainingCost <= m1.summary.trainingCost + 1e-9


def test_linear_and_sampled_shapley(spark):
    from pyspark.ml.regression import LinearRegression
    from tabsight.operators.explain import sampled_attributions
    from tabsight.operators.models import assemble
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").withColumn("rid", F.monotonically_increasing_id())
    cols = ["l_quantity", "l_discount", "l_tax"]
    d = assemble(li, cols).cache()
    m = LinearRegression(labelCol="l_extendedprice").fit(d)
    rows = d.limit(20)
    per = sampled_attributions(m, rows, d, "rid", "features", cols, n_perm=3, per_row=True).toPandas()
    pdf = d.select(*cols).toPandas()
    mean = pdf.mean().to_numpy()
    w = m.coefficients.toArray()
    for rid, g in per.groupby("rid"):
        x = rows.where(F.col("rid") == rid).select(*cols).toPandas().to_numpy()[0]
        exact = dict(zip(cols, w * (x - mean)))
        for _, r in g.iterrows():
            assert r["attribution"] == pytest.approx(exact[r["feature"]], abs=1e-4)


def test_forecast_has_held_out_length(spark):
    from tabsight.operators.forecast import arima_forecast
    from tabsight.operators.series import resample_mean
    h = resample_mean(events(spark), ["event_type"], "ts", "value", "hour")
    fc = arima_forecast(h, ["event_type"], "ts", "value")
    n = {r["event_type"]: r["count"] for r in h.groupBy("event_type").count().collect()}
    got = {r["event_type"]: r["count"] for r in fc.where(F.col("forecast").isNotNull()).groupBy("event_type").count().collect()}
    for k, v in n.items():
        assert got[k] == v - math.floor(v * 0.8)


def test_forecast_recovers_ar_term(spark):
    """ar_diff fixture: differences follow w_t = 0.6 w_{t-1} + e_t."""
    from tabsight.operators.forecast import arima_forecast
    rng = np.random.default_rng(7)
    w = np.zeros(400)
    for t in range(1, 400):
        w[t] = 0.6 * w[t - 1] + rng.normal()
    y = np.cumsum(w)
    pdf = pd.DataFrame({"key": "a", "ts": pd.date_range("2024-01-01", periods=400, freq="h"), "v": y})
    df = spark.createDataFrame(pdf)
    fc = arima_forecast(df, ["key"], "ts", "v", 1, 0, 0.8).orderBy("step").toPandas()
    # one step ahead: last level + 0.6 × last difference (within estimation error)
    last = y[319]
    assert fc["forecast"].iloc[0] == pytest.approx(last + 0.6 * (y[319] - y[318]), abs=0.6)


def test_dtype_and_text_columns(spark):
    from tabsight.operators.columns import text_columns
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    t = {r["column"]: r["is_text"] for r in text_columns(d).collect()}
    assert t == {"text": True, "lang": False, "source": False}


def _brute_dbscan(X, eps, mp):
    n = len(X)
    D = ((X[:, None] - X[None]) ** 2).sum(-1) <= eps * eps
    core = D.sum(1) >= mp
    lab = -np.ones(n, int)
    c = 0
    for i in range(n):
        if not core[i] or lab[i] >= 0:
            continue
        stack, lab[i] = [i], c
        while stack:
            j = stack.pop()
            for k in np.flatnonzero(D[j]):
                if lab[k] < 0:
                    lab[k] = c
                    if core[k]:
                        stack.append(k)
        c += 1
    return lab


def _two_moons(n=300, seed=0):
    rng = np.random.default_rng(seed)
    a = np.linspace(0, np.pi, n // 2)
    X = np.r_[np.c_[np.cos(a), np.sin(a)], np.c_[1 - np.cos(a), 0.5 - np.sin(a)]]
    return X + rng.normal(scale=0.08, size=X.shape)


@pytest.mark.parametrize("eps", [0.1, 0.2, 0.3])
def test_dbscan_two_moons_matches_brute_force(spark, eps):
    from tabsight.operators.dbscan import dbscan
    X = _two_moons()
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)], "id long, v array<double>")
    got = dbscan(df, "id", "v", eps, 5).orderBy("id").toPandas()["cluster"].to_numpy()
    assert (got == _brute_dbscan(X, eps, 5)).all()


def test_dbscan_four_dims_matches_brute_force(spark):
    from tabsight.operators.dbscan import dbscan
    rng = np.random.default_rng(3)
    X = np.r_[rng.normal(0, 0.3, (80, 4)), rng.normal(2, 0.3, (80, 4)), rng.uniform(-2, 4, (40, 4))]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(X)], "id long, v array<double>")
    got = dbscan(df, "id", "v", 0.6, 5).orderBy("id").toPandas()["cluster"].to_numpy()
    assert (got == _brute_dbscan(X, 0.6, 5)).all()


@pytest.mark.parametrize("limits", [{}, {"max_inside": 20, "accuracy": 50}, {"max_inside": 3, "accuracy": 100}])
def test_exact_quantiles_equal_percentile(spark, limits):
    """Infinite values, ties, NULLs and a heavy value; the same method with
    limits that force further rounds."""
    from tabsight.operators.quantiles import exact_quantiles
    ev = events(spark).select(
        "value", F.col("user_id").cast("double").alias("user"),
        F.when(F.col("event_id") % 3 == 0, 7.0).when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("tied"),
        F.when(F.col("event_id") < 9, float("inf")).when(F.col("event_id") < 20, float("-inf")).otherwise(F.col("value")).alias("inf"),
        F.lit(None).cast("double").alias("none"))
    probs = (0.0, 0.003, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = exact_quantiles(ev, {c: F.col(c) for c in ev.columns}, probs, **limits)
    want = ev.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in ev.columns]).first()
    for c in ev.columns:
        for i, p in enumerate(probs):
            w = None if want[c] is None else want[c][i]
            assert got[(c, p)] == w or got[(c, p)] == pytest.approx(w, rel=1e-12, abs=1e-12), (c, p)


def test_statistics_with_either_quantile_method(spark):
    from tabsight.operators.outliers import outlier_comparison
    from tabsight.operators.profile import box_stats
    ev = events(spark)
    assert box_stats(ev, ["value"], exact="percentile").collect() == box_stats(ev, ["value"]).collect()
    assert outlier_comparison(ev, ["value"], exact="percentile").collect() == outlier_comparison(ev, ["value"]).collect()


def test_null_keys_and_one_time_value(spark):
    """Rows with a NULL key stay, and 2,000 rows at one time are spread over
    the partitions; ranks equal a plain window's."""
    from tabsight.operators.ordered import RANK, ordered_rank
    from tabsight.operators.series import add_lags, rolling_stats, time_split
    df = spark.range(2100).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "a").alias("key"),
        F.when(F.col("id") < 2000, F.lit(5)).when(F.col("id") < 2050, F.col("id")).cast("double").alias("t"),
        (F.col("id") % 13).cast("double").alias("v"))
    w = Window.partitionBy("key").orderBy(F.col("t").asc_nulls_first(), "id")
    ranked = ordered_rank(df, ["key"], "t", ["id"], partitions=10)
    assert ranked.select("id", RANK).exceptAll(df.select("id", F.row_number().over(w).alias(RANK))).count() == 0
    sizes = [r["count"] for r in ordered_rank(df, ["key"], "t", ["id"], partitions=10).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2100
    assert rolling_stats(df, ["key"], "t", "v", 3, "id").count() == 2100
    assert time_split(df, ["key"], "t", "id").where("key IS NULL AND split = 'train'").count() == 840
    lag = add_lags(df, ["key"], "t", "v", 1, "id").select("id", "lag_1")
    assert lag.exceptAll(df.select("id", F.lag("v").over(w).alias("lag_1"))).count() == 0


def test_forecast_keeps_null_keys_and_is_repeatable(spark):
    from tabsight.operators.forecast import arima_forecast
    rng = np.random.default_rng(0)
    rows = [(None if i % 2 else "a", i // 4, float(rng.normal()), i) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, t long, v double, id long")
    a = sorted(map(str, arima_forecast(df, ["key"], "t", "v", id_col="id").collect()))
    b = sorted(map(str, arima_forecast(df.repartition(7), ["key"], "t", "v", id_col="id").collect()))
    assert a == b and len(a) == 80 and sum("key=None" in r for r in a) == 40


def test_dense_codes_and_unseen_labels(spark):
    from tabsight.operators.features import decode_labels, label_encode
    train = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "s string")
    test = spark.createDataFrame([("a",), ("zz",), (None,)], "s string")
    got, codes = label_encode(train, ["s"])
    assert sorted(((r["s"] or "nan"), r["s_code"]) for r in got.collect()) == [("a", 0), ("a", 0), ("b", 1), ("c", 2), ("nan", 3)]
    new, _ = label_encode(test, ["s"], fit=train)
    assert {r["s"]: r["s_code"] for r in new.collect()} == {"a": 0, "zz": 4, None: 3}
    names = decode_labels(new, "s_code", codes["s"], "name")
    assert {r["s"]: r["name"] for r in names.collect()} == {"a": "a", "zz": None, None: "nan"}


def test_csv_missing_spellings_do_not_hide_numbers(spark, tmp_path):
    from tabsight.sources.io import read_table
    (tmp_path / "x.csv").write_text("a,b,c,d\n1.5,NA,true,x\nNA,2,n/a,NA\n2.5,3,FALSE,\n")
    df = read_table(spark, str(tmp_path / "x.csv"), "csv")
    assert dict(df.dtypes) == {"a": "double", "b": "bigint", "c": "boolean", "d": "string"}
    assert [tuple(r) for r in df.collect()] == [(1.5, None, True, "x"), (None, 2, None, None), (2.5, 3, False, None)]


def test_train_features_do_not_depend_on_test_rows(spark):
    from tabsight.plans.preprocess import prepare
    df = spark.range(300).select(
        F.col("id"), (F.col("id") % 17 + 1).cast("double").alias("x"), (F.col("id") % 5).cast("string").alias("s"),
        F.concat_ws(" ", F.lit("alpha"), F.concat(F.lit("w"), (F.col("id") % 9).cast("string"))).alias("t"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.rand(3) * 100).alias("z"), (F.col("id") * 1.5).alias("y")).persist()
    from tabsight.operators.features import train_test_split
    test = F.col("split") == "test"
    split = train_test_split(df, "id")
    other = split.select("id", F.when(test, -50.0).otherwise(F.col("x")).alias("x"),
                         F.when(test, F.lit("new")).otherwise(F.col("s")).alias("s"),
                         F.when(test, F.lit("other words here")).otherwise(F.col("t")).alias("t"),
                         F.when(test, None).otherwise(F.col("z")).alias("z"), "y")
    a = prepare(df, "y", "id", text_col="t", auto_fe=True, select=True)
    b = prepare(other, "y", "id", text_col="t", auto_fe=True, select=True)
    assert a.feature_cols == b.feature_cols and a.terms == b.terms and a.terms
    assert a.train.orderBy("id").collect() == b.train.orderBy("id").collect()
    none = prepare(df, None, "id", text_col="t")
    assert none.kind == "clustering" and "label" not in none.train.columns and none.train.count() + none.test.count() == 300


def test_knn_far_from_zero_and_split_cells(spark):
    from tabsight.operators.knn import knn_neighbours
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 3)) + 1e6
    X[:120] = X[0] + rng.normal(scale=1e-3, size=(120, 3))  # one dense cell
    rows = [(i, x.tolist()) for i, x in enumerate(X)]
    tr = spark.createDataFrame(rows[:240], "id long, v array<double>")
    te = spark.createDataFrame(rows[240:] + [(1000, X[5].tolist())], "id long, v array<double>")
    got = {}
    for r in knn_neighbours(tr, te, "id", "v", 5, n_pivots=6, max_group=17).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"]))
    for i, q in [(i, X[i]) for i in range(240, 300)] + [(1000, X[5])]:
        d = np.sqrt(((X[:240] - q) ** 2).sum(1))
        assert [n for _, n in sorted(got[i])] == np.lexsort((np.arange(240), d))[:5].tolist()


def test_dbscan_dense_cell_in_many_dimensions(spark):
    from tabsight.operators import dbscan as D
    rng = np.random.default_rng(4)
    X = np.r_[rng.normal(0, 0.05, (150, 5)), rng.normal(1.5, 0.3, (60, 5)), rng.uniform(-2, 3, (30, 5))] + 1000.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(X)], "id long, v array<double>")
    keep, D.PART_POINTS = D.PART_POINTS, 20
    try:
        got = D.dbscan(df, "id", "v", 0.6, 5).orderBy("id").toPandas()["cluster"].to_numpy()
    finally:
        D.PART_POINTS = keep
    assert (got == _brute_dbscan(X, 0.6, 5)).all()


def test_cluster_scores_noise_and_offset(spark):
    from tabsight.operators.cluster import davies_bouldin, silhouette_sq
    rng = np.random.default_rng(2)
    X = np.r_[rng.normal(0, 1, (30, 2)), rng.normal(9, 1, (30, 2))]

    def frame(shift, labels):
        return spark.createDataFrame([((x + shift).tolist(), lab) for x, lab in zip(X, labels)], "v array<double>, c int")
    two = [0] * 30 + [1] * 30
    for score in (silhouette_sq, davies_bouldin):
        near, far = score(frame(0.0, two), "v", "c", noise=-1).first()[0], score(frame(1e6, two), "v", "c", noise=-1).first()[0]
        assert near == pytest.approx(far, abs=1e-6)
    one_and_noise = frame(0.0, [0] * 30 + [-1] * 30)
    assert silhouette_sq(one_and_noise, "v", "c", noise=-1).first()["silhouette"] == -1.0
    assert davies_bouldin(one_and_noise, "v", "c", noise=-1).first()["davies_bouldin"] == 999.0


def test_shared_folder_is_required_on_a_cluster():
    from tabsight import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_profile_plans_copy_no_rows(spark):
    from tabsight.operators.columns import short_categoricals
    from tabsight.operators.profile import category_counts, profile_columns
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    for df in (profile_columns(li), short_categoricals(li)):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
    plan = category_counts(li, ["l_returnflag", "l_linestatus"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2  # values of all columns, and the row count


def test_multi_class_attributions_sum_to_zero_over_classes(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from tabsight.operators.explain import sampled_attributions, top_feature_pairs
    from tabsight.operators.models import assemble
    df = assemble(spark.range(90).select("id", (F.col("id") % 3).cast("double").alias("label"),
                                         (F.col("id") % 3 * 2).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")), ["a", "b"])
    m = DecisionTreeClassifier(seed=1).fit(df)
    per = sampled_attributions(m, df, df, "id", "features", ["a", "b"], 3, output="probability", per_row=True)
    sums = per.groupBy("id").agg(F.sum("attribution").alias("s"), F.countDistinct("class").alias("k")).collect()
    assert all(abs(r["s"]) < 1e-4 and r["k"] == 3 for r in sums)
    ranked = sampled_attributions(m, df, df, "id", "features", ["a", "b"], 3, output="probability", top=1).collect()
    assert {(r["rank"], r["feature"]) for r in ranked} == {(1, "a")} and len(ranked) == 3
    pairs = top_feature_pairs(m, df, df, "id", "features", ["a", "b"], 3, output="probability").collect()
    assert len(pairs) == 270 and all(r["feature"] == "a" and r["value"] == r["id"] % 3 * 2 for r in pairs)


def test_binomial_draws():
    from tabsight.operators.anomaly import binomial_cumulative
    got = binomial_cumulative(5, 0.3)
    want = np.cumsum([math.comb(5, k) * 0.3 ** k * 0.7 ** (5 - k) for k in range(5)])
    assert np.allclose(got, want) and binomial_cumulative(4, 1.0) == [0.0] * 4


def test_report_facts_with_models(spark):
    from tabsight.operators.profile import dataset_summary
    from tabsight.operators.report import report_facts
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id long, x double")
    lb = spark.createDataFrame([("m1", 0.5), ("m2", 0.75), ("m3", None)], "model string, accuracy double")
    flags = spark.createDataFrame([(1, True), (2, False)], "id long, is_anomaly boolean")
    cl = spark.createDataFrame([("kmeans", 0.25, 3), ("dbscan", -1.0, 1)], "method string, silhouette double, n_clusters int")
    got = {(r["section"], r["key"]): r["value"] for r in report_facts(
        dataset_summary(df), "regression", "x", ["id"], lb, "accuracy", None, ["forest"], flags, cl).collect()}
    assert got[("dataset", "missing")] == "1" and got[("models", "best")] == "m2" and got[("models", "best_score")] == "0.7500"
    assert got[("models", "top3")] == "m2, m1" and got[("models", "tuned")] == "forest" and got[("outliers", "anomalies")] == "1"
    assert got[("clusters", "best")] == "kmeans" and got[("clusters", "silhouette")] == "0.2500" and got[("clusters", "count")] == "3"


def test_csv_round_trip_and_schema_helpers(spark, tmp_path):
    from tabsight.operators.columns import date_candidates, numeric_columns
    from tabsight.operators.profile import dtype_counts
    from tabsight.sources.io import read_table, write_results
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(50)
    path = str(tmp_path / "orders_csv")
    write_results(o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, F.lit("NA"))
                               .otherwise(F.col("o_orderpriority"))), path, "csv")
    back = read_table(spark, path, "csv")
    assert back.count() == 50
    assert back.where(F.col("o_orderpriority").isNull()).count() == o.where(F.col("o_orderkey") % 5 == 0).count()
    assert "o_totalprice" in numeric_columns(back)
    assert date_candidates(o) == ["o_orderdate"]
    assert {r["kind"]: r["n_columns"] for r in dtype_counts(o).collect()} == {"Numeric": 3, "Categorical": 2, "Other": 1}


def test_cap_rows_repeatable(spark):
    from tabsight.sources.io import cap_rows
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    a = [r[0] for r in cap_rows(o, 100, "o_orderkey").select("o_orderkey").collect()]
    b = [r[0] for r in cap_rows(o.repartition(7), 100, "o_orderkey").select("o_orderkey").collect()]
    assert len(a) == 100 and sorted(a) == sorted(b)


def test_cap_rows_are_the_smallest_hashes(spark):
    from tabsight.sources.io import cap_rows
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    h = F.md5(F.concat_ws("|", F.lit("42"), F.col("o_orderkey").cast("string")))
    for n in (5, 700):
        a = sorted(r[0] for r in cap_rows(o, n, "o_orderkey").select("o_orderkey").collect())
        assert a == sorted(r[0] for r in o.orderBy(h, "o_orderkey").limit(n).select("o_orderkey").collect())
    assert cap_rows(o, 10**9, "o_orderkey").count() == o.count()


def test_forecast_blocks_equal_one_block(spark):
    from tabsight.operators.forecast import arima_forecast
    from tabsight.operators.series import resample_mean
    h = resample_mean(events(spark), ["event_type"], "ts", "value", "hour")
    a = arima_forecast(h, ["event_type"], "ts", "value", block_steps=100_000).toPandas()
    b = arima_forecast(h, ["event_type"], "ts", "value", block_steps=7).toPandas()
    m = a.merge(b, on=["event_type", "step"])
    assert len(m) == len(a) == len(b)
    assert np.allclose(m["forecast_x"], m["forecast_y"], rtol=1e-9, atol=1e-9)


def test_correlation_matches_pandas(spark):
    from tabsight.operators.profile import correlation_matrix
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation_matrix(li, cols).collect()}
    pc = li.select(*cols).toPandas().corr()
    for (a, b), v in got.items():
        assert v == pytest.approx(pc.loc[a, b], abs=2e-6)


def test_correlation_pairwise_complete_with_missing(spark):
    from tabsight.operators.profile import correlation_matrix
    ev = events(spark).select(F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("v"),
                              F.col("user_id").cast("double").alias("u"))
    got = correlation_matrix(ev, ["v", "u"]).first()["corr"]
    pdf = ev.toPandas()
    assert got == pytest.approx(pdf["v"].corr(pdf["u"]), abs=2e-6)


def test_tfidf_fitted_vocabulary_and_pandas(spark):
    """Pass-1 statistics (corpus count, document frequency) match a pandas
    count; a fitted vocabulary without ``dfreq`` gives the same weights."""
    from tabsight.operators import text as X
    docs = spark.createDataFrame(
        [(1, "Apple apple banana; cherry!"), (2, "banana banana the kiwi"), (3, None), (4, "x y"),
         (5, "cherry apple apple apple")], "doc_id int, text string")
    vocab = X.tfidf_vocabulary(docs, "text", 3)
    got = {r.term: (r.n, r.dfreq, r.term_index) for r in vocab.collect()}
    assert got == {"apple": (5, 2, 0), "banana": (3, 2, 1), "cherry": (2, 2, 2)}
    full = {(r.doc_id, r.term): r.weight for r in X.tfidf_long(docs, "doc_id", "text", 3).collect()}
    refit = X.tfidf_long(docs, "doc_id", "text", 3, vocabulary=vocab.select("term", "term_index"), n_docs=5)
    assert full == {(r.doc_id, r.term): r.weight for r in refit.collect()}
    # doc 1: tf apple 2, banana 1, cherry 1; idf = ln(6/3) + 1 for all three
    w = np.array([2.0, 1.0, 1.0])
    assert full[(1, "apple")] == round(w[0] / np.linalg.norm(w), 6)
    assert (2, "kiwi") not in full and not any(d in (3, 4) for d, _ in full)


def test_tfidf_output_plan_has_no_hash_shuffle(spark):
    """Pass 2 is map-only: no (document, term) or per-document exchange."""
    from tabsight.operators import text as X
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = X.tfidf_long(docs, "doc_id", "text", 300)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_token_count_edges(spark):
    from tabsight.functions.text import token_count
    df = spark.createDataFrame([(1, ""), (2, "   "), (3, "\n a\tb  c \n"), (4, None), (5, "one")], "id int, t string")
    got = {r.id: r.n for r in df.select("id", token_count(F.col("t")).alias("n")).collect()}
    assert got == {1: 0, 2: 0, 3: 3, 4: None, 5: 1}
