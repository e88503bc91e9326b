"""Queries of the column helpers, file round trips and mergeable profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabsight.operators import columns as C
from tabsight.operators import sketches as Sk
from tabsight.plans.catalog_profile import MASKED_EVENTS_SQL, masked_events
from tabsight.plans.registry import query, table
from tabsight.session import checkpoint_dir


@query("drop_missing", f"SELECT event_id, value FROM {MASKED_EVENTS_SQL} m WHERE value IS NOT NULL AND user_id IS NOT NULL")
def q_drop_missing(spark, sf_dir):
    """Events whose value and user are known."""
    return C.drop_missing(masked_events(spark, sf_dir), ["value", "user_id"]).select("event_id", "value")


@query("fill_missing", f"""
SELECT event_id, coalesce(value, 0.0) AS value, coalesce(value_sparse, 0.0) AS value_sparse,
       coalesce(event_type, '') AS event_type FROM {MASKED_EVENTS_SQL} m
""")
def q_fill_missing(spark, sf_dir):
    """Missing numbers become 0, missing texts the empty text."""
    return C.fill_missing(masked_events(spark, sf_dir).select("event_id", "value", "value_sparse", "event_type"))


@query("public_columns", "SELECT c_custkey, c_name FROM customer")
def q_public_columns(spark, sf_dir):
    """Columns whose name begins with an underscore are internal."""
    return C.public_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("_balance")))


@query("exclude_values", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr')")
def q_exclude_values(spark, sf_dir):
    """Rows without the named values."""
    return C.exclude_values(table(spark, sf_dir, "documents"), "lang", ["en", "fr"]).select("doc_id", "lang")


@query("drop_column", "SELECT o_orderkey, o_totalprice FROM orders")
def q_drop_column(spark, sf_dir):
    """The time column is taken out of the features; unknown names are passed over."""
    return C.drop_column(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderdate", "absent")


@query("sort_by_time", """
SELECT event_id, lag(event_id) OVER (ORDER BY ts, event_id) AS before FROM events WHERE ts IS NOT NULL
""")
def q_sort_by_time(spark, sf_dir):
    """Every event with the one before it in time order, read off the
    sorted rows."""
    from tabsight.operators.ordered import RANK, ordered_rank
    from tabsight.operators.series import sort_by_time
    ranked = ordered_rank(sort_by_time(table(spark, sf_dir, "events"), "ts", "event_id"), [], "ts", ["event_id"], with_count=False)
    before = ranked.select((F.col(RANK) + 1).alias(RANK), F.col("event_id").alias("before"))
    return ranked.join(before, RANK, "left").select("event_id", "before")


@query("column_kinds", """
SELECT * FROM (
  SELECT 'event_id' AS "column", 'numeric' AS kind, false AS date_candidate, count(event_id) AS non_null FROM events
  UNION ALL SELECT 'ts', 'other', true, count(ts) FROM events
  UNION ALL SELECT 'user_id', 'numeric', false, count(user_id) FROM events
  UNION ALL SELECT 'event_type', 'categorical', false, count(event_type) FROM events
  UNION ALL SELECT 'value', 'numeric', false, count(value) FROM events
  UNION ALL SELECT 'props', 'categorical', false, count(props) FROM events)
""")
def q_column_kinds(spark, sf_dir):
    """The kind of every column, whether it may hold the time,
    and how many values it has."""
    ev = table(spark, sf_dir, "events")
    kinds = {**dict.fromkeys(C.numeric_columns(ev), "numeric"), **dict.fromkeys(C.categorical_columns(ev), "categorical"),
             **dict.fromkeys(C.other_columns(ev), "other")}
    dates = set(C.date_candidates(ev))
    counts = ev.agg(*[F.count(F.col(c)).alias(c) for c in ev.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.lit(c in dates).alias("date_candidate"),
                 F.col(c).alias("non_null")) for c in ev.columns])))


@query("csv_round_trip", """
SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events
""")
def q_csv_round_trip(spark, sf_dir):
    """Events written as CSV with a header under the shared checkpoint
    folder, read back with types found in the values."""
    from tabsight.sources.io import read_table, write_results
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    write_results(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    return read_table(spark, path, "csv").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@query("sketch_profile", """
WITH l AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, l_linestatus FROM lineitem)
SELECT 'l_quantity' AS "column", count(*) AS n_rows, min(l_quantity) AS lo, max(l_quantity) AS hi,
       round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, true AS distinct_near, true AS ranks_near FROM l
UNION ALL
SELECT 'l_extendedprice', count(*), min(l_extendedprice), max(l_extendedprice), round(avg(l_extendedprice), 4),
       round(stddev_samp(l_extendedprice), 4), true, true FROM l
UNION ALL
SELECT 'l_linestatus', count(*), NULL, NULL, NULL, NULL, true, true FROM l
""")
def q_sketch_profile(spark, sf_dir):
    """Profile of ``lineitem`` merged from the sketches of its return flags;
    exact parts as such, and whether the estimates are within 5 % (distinct
    counts) and 0.02 (ranks of the quartiles) of the rows."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"),
                                                 F.col("l_extendedprice").cast("double").alias("l_extendedprice"), "l_linestatus")
    profile = Sk.profile_of(Sk.merge_sketches(Sk.sketch_table(li, part=["l_returnflag"])))
    errors = Sk.measured_errors(li, profile)
    return profile.join(errors, "column").select(
        "column", "n_rows", "lo", "hi", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        (F.col("distinct_error") <= 0.05).alias("distinct_near"), (F.coalesce("rank_error", F.lit(0.0)) <= 0.02).alias("ranks_near"))
