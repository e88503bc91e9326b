"""The facts of the final report as (section, key, value) rows.

Every source is aggregated once to one row and unpacked with ``inline``; a
source that is not given adds no facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _facts(row: DataFrame, section: str, facts: dict[str, Column]) -> DataFrame:
    """The values of a one-row table, missing ones left out."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(k).alias("key"), v.cast("string").alias("value"))
        for k, v in facts.items()]))).where("value IS NOT NULL")


def _best(table: DataFrame, metric: str, name: str, n: int) -> DataFrame:
    """One row with ``top``: the first ``n`` (name, metric) by metric, ties by
    name; the table has one row per model."""
    return table.where(F.col(metric).isNotNull()).agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col(metric)).alias("order"), F.col(name).alias("name"), F.col(metric).alias("metric")))), 1, n).alias("top"))


def report_facts(summary: DataFrame, problem: str, target: str | None = None, features: list[str] = (),
                 leaderboard: DataFrame | None = None, metric: str = "accuracy", outliers: DataFrame | None = None,
                 tuned: list[str] | None = None, anomalies: DataFrame | None = None,
                 clusters: DataFrame | None = None, n_features: int = 10) -> DataFrame:
    """``summary``: dataset_summary; ``leaderboard``: (model, metric);
    ``outliers``: rows with a column ``column``; ``tuned``: names of tuned
    models; ``anomalies``: (…, is_anomaly); ``clusters``: (method,
    silhouette, n_clusters), −1 standing for no clustering.  ``n_features``
    is the original's limit on the features named."""
    out = [_facts(summary, "dataset", {
        "rows": F.col("n_rows"), "columns": F.col("n_columns"), "missing": F.col("n_missing"), "problem": F.lit(problem),
        "target": F.lit(target or "none"), "features": F.lit(", ".join(list(features)[:n_features]))})]
    if outliers is not None:
        names = outliers.agg(F.array_join(F.array_sort(F.collect_list("column")), ", ").alias("names"))
        out.append(_facts(names, "outliers", {"columns": F.col("names")}))
    if anomalies is not None:
        n = anomalies.agg(F.count_if("is_anomaly").alias("n"))
        out.append(_facts(n, "outliers", {"anomalies": F.col("n")}))
    if leaderboard is not None:
        first = F.get("top", F.lit(0))
        out.append(_facts(_best(leaderboard, metric, "model", 3), "models", {
            "best": first["name"], "best_score": F.format_string("%.4f", first["metric"].cast("double")),
            "top3": F.array_join(F.transform("top", lambda t: t["name"]), ", ")}))
    if tuned:
        out.append(_facts(summary, "models", {"tuned": F.lit(", ".join(tuned))}))
    if clusters is not None:
        valid = clusters.where("silhouette > -1").withColumn("silhouette", F.col("silhouette").cast("double"))
        best = valid.agg(F.min_by(F.struct("method", "silhouette", "n_clusters"),
                                  F.struct(-F.col("silhouette"), F.col("method"))).alias("b"))
        out.append(_facts(best, "clusters", {"best": F.col("b.method"), "silhouette": F.format_string("%.4f", F.col("b.silhouette")),
                                             "count": F.col("b.n_clusters")}))
    return reduce(DataFrame.unionByName, out)
