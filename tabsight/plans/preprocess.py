"""Table → model-ready train/test DataFrames.

Order of the original tool: drop the date column → drop columns with more
than half missing → infer the problem → encode the target → encode other
strings → median-impute numerics → TF-IDF of a text column → engineered
features → importance-based selection.  Every statistic — sparse columns,
problem kind, label codes, medians, log columns, bin edges, vocabulary,
selection and scaling — is fitted on the train split only (``leaky=True``
fits on all rows, as the original did) and applied to both splits.  Without
a target the table is prepared for clustering (no ``label`` column).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.exprs import is_numeric_type
from tabsight.operators import columns as C
from tabsight.operators import features as Fe
from tabsight.session import settled


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    kind: str
    id_col: str
    feature_cols: list[str]
    generated: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    class_codes: DataFrame | None = None  # (value, code) of the target's classes
    terms: list[str] = field(default_factory=list)  # of the tfidf part of the features


def _kind(df: DataFrame, target: str | None, clearly: int = 1000) -> str:
    """The problem.  A sketch's count far above the limit settles it; else the
    values are counted exactly, which writes every distinct one."""
    guess = C.infer_problem(df, target, exact=False).first()
    if (guess["n_distinct"] or 0) > clearly:
        return guess["problem"]
    return C.infer_problem(df, target).first()["problem"]


def prepare(df: DataFrame, target: str | None, id_col: str, date_col: str | None = None,
            text_col: str | None = None, auto_fe: bool = False, select: bool = False,
            frac: float = 0.8, seed: int = 42, leaky: bool = False, max_features: int = 300,
            presplit: bool = False) -> Prepared:
    """``presplit``: ``df`` has the column of ``train_test_split`` already."""
    df = C.drop_column(df, date_col) if date_col else df
    split = df if presplit else Fe.train_test_split(df, id_col, frac, seed)

    def fitting(d: DataFrame) -> DataFrame:
        return d if leaky else d.where(F.col("split") == "train")
    keep = C.drop_sparse_columns(fitting(split), target).columns
    split = split.select(*[c for c in split.columns if c in keep or c in (id_col, "split")])
    kind = _kind(fitting(split), target)
    codes = None
    if target and kind == "classification":
        codes = Fe.fit_codes(fitting(split), target)
        split = Fe.apply_codes(split, target, codes, "label").withColumn("label", F.col("label").cast("double"))
    elif target:
        split = split.withColumn("label", F.col(target).cast("double"))
    aside = [c for c in (target, id_col, "split", "label") if c]
    strings = [c for c in C.categorical_columns(split, exclude=aside) if c != text_col]
    nums = C.numeric_columns(split, exclude=aside)
    if strings:
        split, _ = Fe.label_encode(split, strings, fit=fitting(split))
    feats = nums + [f"{c}_code" for c in strings]
    if nums:
        split = Fe.impute_median(split, nums, Fe.fit_medians(fitting(split), nums))
    generated: list[str] = []
    if auto_fe and nums:
        split, generated = Fe.auto_features(split, nums, fit=fitting(split))
        feats = feats + generated
    terms: list[str] = []
    if text_col:
        from tabsight.operators.text import attach_features
        split, terms = attach_features(split, id_col, text_col, max_features, fit=fitting(split))
    dropped: list[str] = []
    if select and generated and target:
        from tabsight.operators.models import select_features
        _, _, dropped = select_features(fitting(split), feats, generated, "label", kind)
        feats = [c for c in feats if c not in dropped]
        split = split.drop(*dropped)
    split = split.na.fill(0.0, subset=[c for c in feats if is_numeric_type(split.schema[c].dataType)])
    scaled = Fe.standardize(split, feats, settled(Fe.fit_scaler(fitting(split), feats)), suffix="__z") if feats else split
    from pyspark.ml.feature import VectorAssembler
    text_part = ["tfidf"] if terms else []
    out = VectorAssembler(inputCols=feats + text_part, outputCol="features", handleInvalid="keep").transform(scaled)
    out = VectorAssembler(inputCols=[f"{c}__z" for c in feats] + text_part, outputCol="features_scaled",
                          handleInvalid="keep").transform(out)
    out = out.select(id_col, *(["label"] if target else []), "split", "features", "features_scaled", *feats)
    return Prepared(train=out.where(F.col("split") == "train"), test=out.where(F.col("split") == "test"),
                    kind=kind, id_col=id_col, feature_cols=feats, generated=generated, dropped=dropped,
                    class_codes=codes, terms=terms)
