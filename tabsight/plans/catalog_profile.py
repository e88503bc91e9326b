"""Phase 1 queries: profile, outliers, column predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import columns as C
from tabsight.operators import outliers as O
from tabsight.operators import profile as P
from tabsight.plans.registry import query, table
from tabsight.sources import io

EVENT_NUM = ["event_id", "user_id", "value"]


def masked_events(spark, sf_dir):
    """``events`` with deterministic missing values: ``value`` missing on
    every 7th id, ``value_sparse`` missing on 4 of every 7 ids (> 50 %).
    The fixtures hold no NULL, so null handling is tested on this mask."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 7 <= 3, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value_sparse"),
        "props")


MASKED_EVENTS_SQL = """
(SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
        CASE WHEN event_id % 7 <= 3 THEN NULL ELSE value END AS value_sparse,
        props FROM events)"""


@query("outlier_comparison", """
WITH s AS (
  SELECT avg(value) AS mu, stddev_pop(value) AS sd,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
         avg(user_id) AS mu_u, stddev_pop(user_id) AS sd_u,
         quantile_cont(user_id, 0.25) AS q1_u, quantile_cont(user_id, 0.75) AS q3_u,
         avg(event_id) AS mu_e, stddev_pop(event_id) AS sd_e,
         quantile_cont(event_id, 0.25) AS q1_e, quantile_cont(event_id, 0.75) AS q3_e
  FROM events),
c AS (
  SELECT 'event_id' AS "column",
         count(*) FILTER (WHERE sd_e > 0 AND abs(event_id - mu_e) / sd_e > 3) AS z_outliers,
         count(*) FILTER (WHERE event_id < q1_e - 1.5 * (q3_e - q1_e) OR event_id > q3_e + 1.5 * (q3_e - q1_e)) AS iqr_outliers
  FROM events, s
  UNION ALL
  SELECT 'user_id',
         count(*) FILTER (WHERE sd_u > 0 AND abs(user_id - mu_u) / sd_u > 3),
         count(*) FILTER (WHERE user_id < q1_u - 1.5 * (q3_u - q1_u) OR user_id > q3_u + 1.5 * (q3_u - q1_u))
  FROM events, s
  UNION ALL
  SELECT 'value',
         count(*) FILTER (WHERE sd > 0 AND abs(value - mu) / sd > 3),
         count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
  FROM events, s)
SELECT "column", CAST(z_outliers AS BIGINT) AS z_outliers, CAST(iqr_outliers AS BIGINT) AS iqr_outliers
FROM c WHERE z_outliers > 0 OR iqr_outliers > 0 ORDER BY "column"
""")
def q_outlier_comparison(spark, sf_dir):
    return O.outlier_comparison(table(spark, sf_dir, "events"), EVENT_NUM)


def _masked_count(col, is_float=False):
    cond = f"{col} IS NULL" + (f" OR isnan({col})" if is_float else "")
    return f"count(*) FILTER (WHERE {cond})"


@query("dataset_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(7 AS BIGINT) AS n_columns,
       CAST({_masked_count('event_id')} + {_masked_count('ts')} + {_masked_count('user_id')}
          + {_masked_count('event_type')} + {_masked_count('value', True)}
          + {_masked_count('value_sparse', True)} + {_masked_count('props')} AS BIGINT) AS n_missing,
       CAST(4 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_categorical, CAST(1 AS BIGINT) AS n_other
FROM {MASKED_EVENTS_SQL} m
""")
def q_dataset_summary(spark, sf_dir):
    return P.dataset_summary(masked_events(spark, sf_dir))


def _missing_row(col, is_float=False):
    return f"""SELECT '{col}' AS "column", CAST({_masked_count(col, is_float)} AS BIGINT) AS n_missing,
       round({_masked_count(col, is_float)} * 100.0 / count(*), 4) AS pct_missing FROM {MASKED_EVENTS_SQL} m"""


@query("missing_report", f"""
SELECT "column", n_missing, pct_missing,
       CASE WHEN pct_missing > 50 THEN 'high' WHEN pct_missing > 20 THEN 'medium' ELSE 'low' END AS severity
FROM ({_missing_row('event_id')} UNION ALL {_missing_row('ts')} UNION ALL {_missing_row('user_id')}
      UNION ALL {_missing_row('event_type')} UNION ALL {_missing_row('value', True)}
      UNION ALL {_missing_row('value_sparse', True)} UNION ALL {_missing_row('props')}) t
WHERE n_missing > 0
""")
def q_missing_report(spark, sf_dir):
    return P.missing_report(masked_events(spark, sf_dir))


LI_FEAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(tbl, cols):
    parts = [f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS "count",
       round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(min({c}), 2) AS "min",
       round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50,
       round(quantile_cont({c}, 0.75), 2) AS p75, round(max({c}), 2) AS "max" FROM {tbl}""" for c in cols]
    return " UNION ALL ".join(parts)


@query("describe_numeric", _describe_sql("lineitem", LI_FEAT))
def q_describe_numeric(spark, sf_dir):
    return P.describe_numeric(table(spark, sf_dir, "lineitem"), LI_FEAT)


_PROFILE_COLS = [("event_id", "bigint", False), ("ts", "timestamp_ntz", False), ("user_id", "bigint", False),
                 ("event_type", "string", False), ("value", "double", True),
                 ("value_sparse", "double", True), ("props", "string", False)]


@query("profile_columns", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{t}' AS dtype,
       CAST(count(*) - {_masked_count(c, fl)} AS BIGINT) AS non_null,
       CAST({_masked_count(c, fl)} AS BIGINT) AS n_null,
       CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
       round({_masked_count(c, fl)} * 100.0 / count(*), 1) AS null_pct
FROM {MASKED_EVENTS_SQL} m""" for c, t, fl in _PROFILE_COLS))
def q_profile_columns(spark, sf_dir):
    return P.profile_columns(masked_events(spark, sf_dir))


@query("value_counts_target", """
SELECT o_orderstatus AS value, CAST(count(*) AS BIGINT) AS "count",
       round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus
""")
def q_value_counts_target(spark, sf_dir):
    return P.value_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("category_counts", """
WITH g AS (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders
  WHERE o_orderstatus IS NOT NULL GROUP BY 2
  UNION ALL
  SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders
  WHERE o_orderpriority IS NOT NULL GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM g)
SELECT "column", CAST(rank AS INTEGER) AS rank, value, CAST(n AS BIGINT) AS "count",
       round(n * 100.0 / (SELECT count(*) FROM orders), 4) AS pct
FROM r WHERE rank <= 12
""")
def q_category_counts(spark, sf_dir):
    return P.category_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def _hist_sql(tbl, col, bins):
    return f"""
WITH s0 AS (SELECT min({col}) AS lo0, max({col}) AS hi0 FROM {tbl} WHERE {col} IS NOT NULL),
s AS (SELECT CASE WHEN hi0 > lo0 THEN lo0 ELSE lo0 - 0.5 END AS lo,
             CASE WHEN hi0 > lo0 THEN hi0 ELSE hi0 + 0.5 END AS hi FROM s0),
c AS (SELECT CAST(least(floor(({col} - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM {tbl}, s WHERE {col} IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) AS lo, round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS "count"
FROM g CROSS JOIN s LEFT JOIN c ON g.bin = c.bin"""


@query("histogram_target", _hist_sql("events", "value", 40))
def q_histogram_target(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "events"), "value", 40)


@query("center_markers", """
SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events
""")
def q_center_markers(spark, sf_dir):
    return P.center_markers(table(spark, sf_dir, "events"), "value")


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]


def _corr_sql():
    parts = []
    for i, a in enumerate(LI_NUM):
        for j in range(i):
            b = LI_NUM[j]
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
  round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS corr
  FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL""")
    return " UNION ALL ".join(parts)


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf_dir):
    return P.correlation_matrix(table(spark, sf_dir, "lineitem"), LI_NUM)


def _box_sql(tbl, cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS "column", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
  round((SELECT min({c}) FROM {tbl} WHERE {c} >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
  round((SELECT max({c}) FROM {tbl} WHERE {c} <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  round(mu, 6) AS mean, round(sd, 6) AS std,
  (SELECT CAST(count(*) AS BIGINT) FROM {tbl} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3,
             avg({c}) AS mu, stddev_samp({c}) AS sd FROM {tbl}) s""")
    return " UNION ALL ".join(parts)


@query("box_stats", _box_sql("events", ["value", "user_id"]))
def q_box_stats(spark, sf_dir):
    return P.box_stats(table(spark, sf_dir, "events"), ["value", "user_id"])


def _zsql(tbl, cols):
    parts = [f"""SELECT '{c}' AS "column", CAST(count(*) FILTER (WHERE sd > 0 AND abs({c} - mu) / sd > 3) AS BIGINT) AS n_outliers
  FROM {tbl}, (SELECT avg({c}) AS mu, stddev_pop({c}) AS sd FROM {tbl}) s""" for c in cols]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") t WHERE n_outliers > 0"


def _iqrsql(tbl, cols):
    parts = [f"""SELECT '{c}' AS "column", CAST(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
  FROM {tbl}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {tbl}) s""" for c in cols]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") t WHERE n_outliers > 0"


DOC_NUM = ["doc_id", "n_chars"]


@query("zscore_outliers", _zsql("documents", DOC_NUM))
def q_zscore_outliers(spark, sf_dir):
    return O.zscore_outliers(table(spark, sf_dir, "documents"), DOC_NUM)


@query("iqr_outliers", _iqrsql("documents", DOC_NUM))
def q_iqr_outliers(spark, sf_dir):
    return O.iqr_outliers(table(spark, sf_dir, "documents"), DOC_NUM)


_ME_COLS = "event_id, ts, user_id, event_type, value, value_sparse, props"


def _zfilter_sql(src, cols):
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS med{i}" for i, c in enumerate(cols))
    moms = ", ".join(f"avg(coalesce({c}, med{i})) AS mu{i}, stddev_pop(coalesce({c}, med{i})) AS sd{i}"
                     for i, c in enumerate(cols))
    keep = " AND ".join(f"(sd{i} IS NULL OR sd{i} = 0 OR abs(coalesce({c}, med{i}) - mu{i}) / sd{i} <= 3)"
                        for i, c in enumerate(cols))
    return f"""(SELECT {_ME_COLS} FROM {src} src,
  (SELECT * FROM (SELECT {meds} FROM {src} a) md,
      LATERAL (SELECT {moms} FROM {src} b) mo) st
  WHERE {keep})"""


@query("remove_z_outliers", "SELECT * FROM " + _zfilter_sql(MASKED_EVENTS_SQL, ["value", "user_id"]) + " r")
def q_remove_z_outliers(spark, sf_dir):
    return O.remove_z_outliers(masked_events(spark, sf_dir), ["value", "user_id"], mode="single_pass")


@query("remove_z_outliers_sequential",
       "SELECT * FROM " + _zfilter_sql(_zfilter_sql(MASKED_EVENTS_SQL, ["value"]), ["user_id"]) + " r")
def q_remove_z_outliers_sequential(spark, sf_dir):
    return O.remove_z_outliers(masked_events(spark, sf_dir), ["value", "user_id"], mode="sequential")


def _tokcount_sql(c):
    return f"len(list_filter(regexp_split_to_array(trim({c}), '\\s+'), lambda x: x <> ''))"


@query("text_columns", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST(avg({_tokcount_sql(c)}) FILTER (WHERE {c} IS NOT NULL) AS DOUBLE) AS mean_tokens,
       coalesce(avg({_tokcount_sql(c)}) FILTER (WHERE {c} IS NOT NULL) > 5, false) AS is_text
FROM documents""" for c in ["text", "lang", "source"]))
def q_text_columns(spark, sf_dir):
    return C.text_columns(table(spark, sf_dir, "documents")).select(
        "column", F.col("mean_tokens"), "is_text")


@query("drop_sparse_columns", f"""
SELECT event_id, ts, user_id, event_type, value, props FROM {MASKED_EVENTS_SQL} m
""")
def q_drop_sparse_columns(spark, sf_dir):
    return C.drop_sparse_columns(masked_events(spark, sf_dir), target="value")


@query("infer_problem", """
SELECT 'o_orderstatus' AS target, 'string' AS dtype, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_distinct,
       'classification' AS problem FROM orders
UNION ALL
SELECT 'o_totalprice', 'double', CAST(count(DISTINCT o_totalprice) AS BIGINT),
       CASE WHEN count(DISTINCT o_totalprice) <= 20 THEN 'classification' ELSE 'regression' END FROM orders
""")
def q_infer_problem(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return C.infer_problem(o, "o_orderstatus").unionByName(C.infer_problem(o, "o_totalprice"))


@query("short_categoricals", """
SELECT * FROM (
  SELECT CAST(0 AS INTEGER) AS position, 'c_name' AS "column", CAST(count(DISTINCT c_name) AS BIGINT) AS n_distinct FROM customer
  UNION ALL
  SELECT CAST(1 AS INTEGER), 'c_mktsegment', CAST(count(DISTINCT c_mktsegment) AS BIGINT) FROM customer) t
WHERE n_distinct <= 15
""")
def q_short_categoricals(spark, sf_dir):
    return C.short_categoricals(table(spark, sf_dir, "customer"))


@query("cap_rows", """
SELECT * FROM orders ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 1000
""")
def q_cap_rows(spark, sf_dir):
    return io.cap_rows(table(spark, sf_dir, "orders"), 1000, "o_orderkey", seed=42)


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def q_preview(spark, sf_dir):
    return io.preview(table(spark, sf_dir, "orders"), 5, "o_orderkey")


@query("isolation_forest")
def q_isolation_forest(spark, sf_dir):
    """100 trees of 256 hashed rows; the top 5 % of scores are anomalies."""
    from tabsight.operators.anomaly import isolation_forest
    return isolation_forest(table(spark, sf_dir, "events"), "event_id", ["user_id", "value"])
