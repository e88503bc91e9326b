"""Model evaluation tables.

Predictions are a DataFrame with a label and a prediction column, and
optionally a ``model`` column so that many models are scored by one grouped
aggregate.  Per-class counts come from a single pass in which every row
contributes once as "actual" and once as "predicted".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.functions.exprs import kurt_unbiased, skew_unbiased


def class_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                 by: list[str] | None = None) -> DataFrame:
    """(by…, class, support, predicted, tp) over the union of actual and
    predicted classes."""
    by = list(by or [])
    hit = (F.col(label) == F.col(prediction)).cast("int")
    two = F.explode(F.array(
        F.struct(F.col(label).cast("string").alias("cls"), F.lit(1).alias("a"), F.lit(0).alias("p"), hit.alias("tp")),
        F.struct(F.col(prediction).cast("string").alias("cls"), F.lit(0).alias("a"), F.lit(1).alias("p"),
                 F.lit(0).alias("tp"))))
    e = pred.select(*by, two.alias("r")).select(*by, "r.*")
    return e.groupBy(*by, F.col("cls").alias("class")).agg(
        F.sum("a").cast("bigint").alias("support"), F.sum("p").cast("bigint").alias("predicted"),
        F.sum("tp").cast("bigint").alias("tp"))


def _prf(cc: DataFrame) -> DataFrame:
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("predicted") > 0,
                2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return cc.select("*", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def classification_scores(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Accuracy and support-weighted F1 (per ``by`` group)."""
    by = list(by or [])
    per = _prf(class_counts(pred, label, prediction, by))
    return per.groupBy(*by).agg(
        F.round(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), digits).alias("f1_weighted"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: list[str] | None = None, max_classes: int = 1000, codes: DataFrame | None = None) -> DataFrame:
    """Long confusion matrix over all (actual, predicted) class pairs, zero
    cells included → (by…, actual, predicted, count).  A matrix has at most
    ``max_classes`` ** 2 cells; more classes are an error (use
    ``class_counts`` there).  ``codes`` (value, code) turns class codes back
    into class names."""
    by = list(by or [])
    classes = class_counts(pred, label, prediction, by).select(*by, "class")
    most = classes.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most > max_classes:
        raise ValueError(f"{most} classes; a confusion matrix is made for at most {max_classes}")
    counts = pred.groupBy(*by, F.col(label).cast("string").alias("actual"),
                          F.col(prediction).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    actual, predicted = classes.withColumnRenamed("class", "actual"), classes.withColumnRenamed("class", "predicted")
    grid = actual.join(predicted, by) if by else actual.crossJoin(predicted)  # ≤ max_classes rows each
    out = grid.join(counts, [*by, "actual", "predicted"], "left").select(
        *by, "actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    if codes is not None:
        names = codes.select(F.col("code").cast("double").alias("__code"), F.col("value").alias("__name"))
        for c in ("actual", "predicted"):
            out = (out.join(names, F.col(c).cast("double") == F.col("__code"), "left")
                   .withColumn(c, F.coalesce("__name", c)).drop("__code", "__name"))
    return out


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          digits: int = 3) -> DataFrame:
    """Per class precision, recall, F1 and support, then rows ``accuracy``,
    ``macro avg`` and ``weighted avg`` → (row, precision, recall, f1, support)."""
    per = _prf(class_counts(pred, label, prediction))
    r = lambda c: F.round(c, digits)
    classes = per.select(F.col("class").alias("row"), r(F.col("precision")).alias("precision"),
                         r(F.col("recall")).alias("recall"), r(F.col("f1")).alias("f1"),
                         F.col("support").cast("double").alias("support"))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                  F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = F.col("tp") / F.col("n")
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("row"), r(acc).alias("precision"), r(acc).alias("recall"),
                 r(acc).alias("f1"), F.col("n").cast("double").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), r(F.col("sp") / F.col("k")).alias("precision"),
                 r(F.col("sr") / F.col("k")).alias("recall"), r(F.col("sf") / F.col("k")).alias("f1"),
                 F.col("n").cast("double").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), r(F.col("wp") / F.col("n")).alias("precision"),
                 r(F.col("wr") / F.col("n")).alias("recall"), r(F.col("wf") / F.col("n")).alias("f1"),
                 F.col("n").cast("double").alias("support")))))
    return classes.unionByName(summary)


def regression_scores(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                      by: list[str] | None = None, digits: int = 4, band: float = 0.10) -> DataFrame:
    """R², RMSE, MAE and the share of rows within ±``band`` of the prediction."""
    by = list(by or [])
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    res = y - p
    g = pred.groupBy(*by).agg(F.count(y).alias("n"), F.sum(res * res).alias("ss_res"),
                              F.var_pop(y).alias("var_y"), F.avg(F.abs(res)).alias("mae"),
                              F.avg((F.abs(res) <= F.abs(p) * band).cast("double")).alias("in_band"))
    r2 = F.when(F.col("var_y") > 0, 1 - F.col("ss_res") / (F.col("var_y") * F.col("n")))
    return g.select(*by, F.col("n").cast("bigint").alias("n"), F.round(r2, digits).alias("r2"),
                    F.round(F.sqrt(F.col("ss_res") / F.col("n")), digits).alias("rmse"),
                    F.round("mae", digits).alias("mae"), F.round("in_band", digits).alias("share_in_band"))


def error_columns(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                  band: float = 0.10) -> DataFrame:
    """residual, absolute error, inside the ±band around the prediction."""
    res = F.col(label).cast("double") - F.col(prediction).cast("double")
    return pred.select("*", res.alias("residual"), F.abs(res).alias("abs_error"),
                       (F.abs(res) <= F.abs(F.col(prediction)) * band).alias("in_band"))


def worst_predictions(pred: DataFrame, id_cols: list[str], label: str = "label",
                      prediction: str = "prediction", n: int = 3) -> DataFrame:
    """The ``n`` largest absolute errors (ties by id): a distributed top-k."""
    e = error_columns(pred, label, prediction)
    return e.orderBy(F.desc("abs_error"), *id_cols).limit(n)


def residual_summary(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     digits: int = 6) -> DataFrame:
    """Mean, population std, bias-corrected skewness and excess kurtosis of
    residuals (pandas ``skew``/``kurt``)."""
    res = F.col(label).cast("double") - F.col(prediction).cast("double")
    g = pred.agg(F.count(res).alias("n"), F.avg(res).alias("mean"), F.stddev_pop(res).alias("std"),
                 F.skewness(res).alias("g1"), F.kurtosis(res).alias("g2"))
    n = F.col("n").cast("double")
    return g.select(F.col("n").cast("bigint").alias("n"), F.round("mean", digits).alias("mean"),
                    F.round("std", digits).alias("std"),
                    F.round(skew_unbiased(n, F.col("g1")), digits).alias("skew"),
                    F.round(kurt_unbiased(n, F.col("g2")), digits).alias("kurtosis"))


def with_residual(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.withColumn("residual", F.col(label).cast("double") - F.col(prediction).cast("double"))


# ---------------------------------------------------------------- leaderboards
INVERTED = ("rmse", "mse", "mae", "davies_bouldin")


def leaderboard(scores: DataFrame, metric: str, name: str = "model", digits: int = 4) -> DataFrame:
    """Order by ``metric`` descending (ties by name): rank, medal for the top
    three, score as % of the best.  A leaderboard has one row per model, so
    the ordered window over it is small by construction."""
    w = Window.orderBy(F.desc_nulls_last(metric), name)
    best = scores.agg(F.max(metric).alias("__best"))
    out = scores.crossJoin(F.broadcast(best)).withColumn("rank", F.row_number().over(w))
    medal = F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver").when(F.col("rank") == 3, "bronze")
    return out.select("*", medal.alias("medal"),
                      F.round(F.try_divide(F.col(metric) * 100.0, F.col("__best")), digits).alias("pct_of_best")).drop("__best")


def minmax_normalise(lb: DataFrame, metrics: list[str], digits: int = 6) -> DataFrame:
    """(v − min)/(max − min) per metric across models, 0.5 when there is no
    spread; error metrics are inverted so that larger is better."""
    st = lb.agg(*[F.min(m).alias(f"__lo_{m}") for m in metrics], *[F.max(m).alias(f"__hi_{m}") for m in metrics])
    out = lb.crossJoin(F.broadcast(st))
    for m in metrics:
        lo, hi = F.col(f"__lo_{m}"), F.col(f"__hi_{m}")
        v = F.when(hi > lo, (F.col(m) - lo) / (hi - lo)).otherwise(F.lit(0.5))
        if m.lower() in INVERTED:
            v = F.when(hi > lo, 1 - v).otherwise(F.lit(0.5))
        out = out.withColumn(f"{m}_norm", F.round(v, digits))
    return out.drop(*[f"__lo_{m}" for m in metrics], *[f"__hi_{m}" for m in metrics])


def radar_table(lb: DataFrame, metrics: list[str], metric: str, name: str = "model", n: int = 4,
                max_metrics: int = 6) -> DataFrame:
    """Top ``n`` models with the first ``max_metrics`` metrics (the original's
    limits are the defaults) min-max normalised."""
    metrics = metrics[:max_metrics]
    norm = minmax_normalise(lb, metrics)
    return norm.orderBy(F.desc_nulls_last(metric), name).limit(n).select(
        name, *[f"{m}_norm" for m in metrics])


def gauge_table(lb: DataFrame, metric: str, name: str = "model", n: int = 4, max_val: float = 1.0,
                digits: int = 6) -> DataFrame:
    """Top ``n`` scores as a gauge fraction min(score / max_val, 1)."""
    return lb.orderBy(F.desc_nulls_last(metric), name).limit(n).select(
        name, metric, F.round(F.least(F.col(metric) / F.lit(max_val), F.lit(1.0)), digits).alias("fraction"))
