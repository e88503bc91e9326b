"""Named queries: each is a Spark function ``(spark, sf_dir) -> DataFrame``
plus, where SQL can express it, the equivalent DuckDB SQL over the same
Parquet tables (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query; ``sql`` may be a function, called only when the SQL
    is asked for.  Importing a catalogue module again replaces its own
    entries; two functions of one name are an error."""
    def deco(fn):
        old = QUERIES.get(name)
        if old is not None and (old.__module__, old.__qualname__) != (fn.__module__, fn.__qualname__):
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all():
    """Import every catalogue module (registration happens on import)."""
    from tabsight.plans import (  # noqa: F401
        catalog_profile, catalog_text, catalog_series, catalog_features,
        catalog_evaluate, catalog_models, catalog_cluster, catalog_report, catalog_columns,
        catalog_checks,
    )
    return dict(QUERIES), {k: (v() if callable(v) else v).strip() for k, v in ORACLE.items()}
