"""Model explanation by sampled Shapley values.

For every explained row, ``n_perm`` seeded feature orders are drawn (order =
features sorted by a hash of (row id, permutation, feature)).  Walking an
order from a reference point (the feature means of the background rows) to
the row, each step switches one feature to the row's value; the change of
the model output is that feature's contribution.  All (row, permutation,
step) vectors are built as one DataFrame and scored by ONE
``model.transform``; contributions come from a ``lag`` over the steps of a
(row, permutation) — d + 1 rows per window — and are averaged.

Per row and permutation the contributions sum exactly to
f(row) − f(reference); averaging over permutations keeps that.  Works for
any Spark ML model that reads a vector column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attributions(model, rows: DataFrame, background: DataFrame, id_col: str, features: str, names: list[str],
                 n_perm: int = 10, seed: int = 42, output: str = "prediction") -> DataFrame:
    """(id, feature, value, class, attribution) of every row and feature.
    ``output='probability'`` explains the probability of each class (class is
    its number), any other column one number (class is NULL)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    d = len(names)
    ref = background.select(vector_to_array(features).alias("__b")).agg(
        *[F.avg(F.col("__b")[i]).alias(f"m{i}") for i in range(d)])
    ref = ref.select(F.array(*[F.col(f"m{i}") for i in range(d)]).alias("__ref"))  # one row
    x = rows.select(id_col, vector_to_array(features).alias("__x")).crossJoin(F.broadcast(ref))
    x = x.select(id_col, "__x", "__ref", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("__perm"))
    # position of every feature in this permutation
    every = F.sequence(F.lit(0), F.lit(d - 1))
    keyed = F.transform(every, lambda i: F.struct(
        F.xxhash64(F.col(id_col), F.col("__perm"), i, F.lit(seed)).alias("h"), i.alias("f")))
    x = x.withColumn("__order", F.transform(F.array_sort(keyed), lambda s: s["f"]))
    x = x.withColumn("__pos", F.transform(every, lambda i: F.array_position(F.col("__order"), i) - 1))
    steps = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("__step"))
    z = F.transform(every, lambda i: F.when(F.col("__pos")[i] < F.col("__step"), F.col("__x")[i]).otherwise(F.col("__ref")[i]))
    scored = model.transform(steps.withColumn(features, array_to_vector(z)))
    out = vector_to_array(F.col("probability")) if output == "probability" else F.array(F.col(output).cast("double"))
    w = Window.partitionBy(id_col, "__perm").orderBy("__step")  # d + 1 rows per window
    contrib = (scored.select(id_col, "__perm", "__step", "__order", "__x", out.alias("__f"))
               .withColumn("__delta", F.zip_with("__f", F.lag("__f").over(w), lambda a, b: a - b))
               .where(F.col("__step") > 0)
               .withColumn("feature_idx", F.col("__order")[F.col("__step") - 1]))
    cls = F.col("class") if output == "probability" else F.lit(None).cast("int")
    per = (contrib.select(id_col, "feature_idx", F.col("__x")[F.col("feature_idx")].alias("value"),
                          F.posexplode("__delta").alias("class", "__d"))
           .groupBy(id_col, "feature_idx", "value", "class").agg((F.sum("__d") / F.lit(n_perm)).alias("attribution")))
    names_df = rows.sparkSession.createDataFrame(list(enumerate(names)), "feature_idx int, feature string")
    return per.join(F.broadcast(names_df), "feature_idx").select(  # d rows
        id_col, "feature", "value", cls.alias("class"), "attribution")


def sampled_attributions(model, rows: DataFrame, background: DataFrame, id_col: str,
                         features: str, names: list[str], n_perm: int = 10, seed: int = 42,
                         output: str = "prediction", per_row: bool = False, digits: int = 6,
                         top: int | None = None) -> DataFrame:
    """(rank, class, feature, mean_abs_attribution), largest first within a
    class and at most ``top`` of them; ``per_row``: (id, feature, class,
    attribution)."""
    per = attributions(model, rows, background, id_col, features, names, n_perm, seed, output)
    if per_row:
        return per.select(id_col, "feature", "class", F.round("attribution", digits).alias("attribution"))
    w = Window.partitionBy("class").orderBy(F.desc("mean_abs_attribution"), "feature")  # d rows per class
    out = (per.groupBy("class", "feature").agg(F.round(F.avg(F.abs("attribution")), digits).alias("mean_abs_attribution"))
           .withColumn("rank", F.row_number().over(w)))
    return (out.where(F.col("rank") <= top) if top else out).select("rank", "class", "feature", "mean_abs_attribution")


def top_feature_pairs(model, rows: DataFrame, background: DataFrame, id_col: str, features: str, names: list[str],
                      n_perm: int = 10, seed: int = 42, output: str = "prediction", digits: int = 6) -> DataFrame:
    """(id, class, feature, value, attribution) of the feature of highest mean
    |attribution| over all rows and classes (ties by name), in one pass over
    the rows' attributions."""
    per = attributions(model, rows, background, id_col, features, names, n_perm, seed, output)
    best = (per.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("m"))
            .orderBy(F.desc("m"), "feature").limit(1).select("feature"))
    return per.join(F.broadcast(best), "feature").select(
        id_col, "class", "feature", F.round("value", digits).alias("value"), F.round("attribution", digits).alias("attribution"))
