"""Sources and sinks (S1–S6) and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: text read as missing from CSV (pandas' default NA set) ---
PANDAS_NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# ---------------------------------------------------------------------------

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read a table.  CSV is read with a header; without a schema every
    column is read as text, each pandas NA spelling becomes NULL, and a
    column whose remaining values all parse becomes bigint, double or boolean
    (one aggregate decides), so ``1.5, NA, 2.5`` is a number column."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt != "csv":
        return reader.options(**options).format(fmt).load(path)
    df = reader.option("header", True).options(**options).csv(path)
    na = list(PANDAS_NA_STRINGS)
    df = df.select(*[
        (F.when(F.trim(F.col(f"`{f.name}`")).isin(na), F.lit(None).cast("string")).otherwise(F.col(f"`{f.name}`"))
         if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
    return df if schema is not None else infer_types(df)


#: Forms read as numbers and truth values.
NUMBER_FORMS = {"bigint": r"^[+-]?[0-9]{1,18}$",
                "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf|[iI]nfinity)$",
                "boolean": r"^([tT]rue|TRUE|[fF]alse|FALSE)$"}


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each text column to the first of bigint, double and boolean that
    all its non-missing values have the form of (columns without values stay
    text)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    aggs = []
    for i, c in enumerate(text):
        v = F.trim(F.col(f"`{c}`"))
        aggs.append(F.count(v).alias(f"n{i}"))
        aggs += [F.count_if(v.rlike(form)).alias(f"{kind}{i}") for kind, form in NUMBER_FORMS.items()]
    got = df.agg(*aggs).first()
    kinds = {c: next((k for k in NUMBER_FORMS if got[f"n{i}"] and got[f"{k}{i}"] == got[f"n{i}"]), None)
             for i, c in enumerate(text)}
    return df.select(*[(F.trim(F.col(f"`{c}`")).cast(kinds[c]) if kinds.get(c) else F.col(f"`{c}`")).alias(c) for c in df.columns])


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _hash_order(id_cols: list[str], seed: int):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


def cap_rows(df: DataFrame, n: int, id_cols: list[str] | str, seed: int = 42, exact: bool = True) -> DataFrame:
    """Repeatable uniform sample of ``n`` rows (no replacement).

    ``exact=True``: the ``n`` rows with the smallest seeded hash of the id
    (ties by id) — the same rows however the table is partitioned.  A hash
    threshold is taken from a sketch quantile (with margin), so only about
    ``n`` rows in all, not ``n`` per task, reach the final cut; the threshold
    is widened if too few pass.
    ``exact=False``: a Bernoulli sample of the expected size.
    The cap is off unless the caller asks for it.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    total = df.count()
    if total <= n:
        return df
    if not exact:
        return df.sample(withReplacement=False, fraction=min(1.0, n / total), seed=seed)
    h = "__cap_hash"
    hashed = df.withColumn(h, _hash_order(ids, seed))
    num = F.conv(F.substring(F.col(h), 1, 15), 16, 10).cast("long")
    share = n / total
    while True:
        share = min(1.0, share * 1.1 + 2e-4)  # past the error of the sketch
        kept = hashed
        if share < 1.0:
            top = hashed.agg(F.percentile_approx(num, F.lit(share), 10_000).alias("t")).first()["t"]
            kept = hashed.where(num <= F.lit(top))
        if share >= 1.0 or kept.count() >= n:
            return kept.orderBy(h, *ids).limit(n).drop(h)


def preview(df: DataFrame, n: int, id_cols: list[str] | str) -> DataFrame:
    """First ``n`` rows in id order (the row index of a file)."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return df.orderBy(*ids).limit(n)


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def save_model(model, path: str) -> None:
    """Persist a fitted ``PipelineModel`` (scaler, encoders and estimator are
    its stages, so one save covers S5 and S6)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def union_all_by_name(*dfs: DataFrame) -> DataFrame:
    """Stack tables whose columns differ; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()
