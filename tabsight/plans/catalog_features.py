"""Phase 3 queries: encoding, imputation, scaling, engineered features, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import features as Fe
from tabsight.plans.catalog_profile import LI_FEAT, MASKED_EVENTS_SQL, masked_events
from tabsight.plans.registry import query, table

SPLIT_SQL = "(CAST(('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100)"


@query("label_encode", """
SELECT o_orderkey, o_orderstatus, o_orderpriority,
       CAST(dense_rank() OVER (ORDER BY coalesce(o_orderstatus, 'nan')) - 1 AS INTEGER) AS o_orderstatus_code,
       CAST(dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS INTEGER) AS o_orderpriority_code
FROM orders
""")
def q_label_encode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out, _ = Fe.label_encode(o, ["o_orderstatus", "o_orderpriority"])
    return out


@query("impute_median", f"""
SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {MASKED_EVENTS_SQL} a)) AS value
FROM {MASKED_EVENTS_SQL} m
""")
def q_impute_median(spark, sf_dir):
    return Fe.impute_median(masked_events(spark, sf_dir).select("event_id", "value"), ["value"])


@query("standardize", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(CASE WHEN sd_{c} > 0 THEN ({c} - mu_{c}) / sd_{c} ELSE 0 END, 6) AS {c}" for c in LI_FEAT)
    + " FROM lineitem, (SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in LI_FEAT)
    + " FROM lineitem) s")
def q_standardize(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LI_FEAT)
    out = Fe.standardize(li, LI_FEAT)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in LI_FEAT])


# squares of prices reach 1e10: fewer decimals keep the rounding exact
_SQ_DIGITS = {"l_quantity": 6, "l_extendedprice": 2, "l_discount": 6, "l_tax": 6}


@query("square_features", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({c} * {c}, {_SQ_DIGITS[c]}) AS {c}_sq" for c in LI_FEAT) + " FROM lineitem")
def q_square_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LI_FEAT)
    out = Fe.square_features(li, LI_FEAT)
    return out.select("l_orderkey", "l_linenumber", *[F.round(f"{c}_sq", _SQ_DIGITS[c]).alias(f"{c}_sq") for c in LI_FEAT])


_PAIRS = Fe.interaction_pairs(LI_FEAT)


@query("interaction_features", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({a} * {b}, 6) AS {a}_x_{b}" for a, b in _PAIRS) + " FROM lineitem")
def q_interaction_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LI_FEAT)
    out = Fe.interaction_features(li, LI_FEAT)
    names = [f"{a}_x_{b}" for a, b in _PAIRS]
    return out.select("l_orderkey", "l_linenumber", *[F.round(n, 6).alias(n) for n in names])


_LOG_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("log_features", " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, 'log_{c}' AS feature, round(ln(1 + {c}), 6) AS value FROM lineitem "
    f"WHERE (SELECT min({c}) > 0 FROM lineitem)" for c in _LOG_COLS))
def q_log_features(spark, sf_dir):
    """The log features in long form: which columns get one is in the rows."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_LOG_COLS)
    out = Fe.log_features(li, _LOG_COLS)
    logs = [c for c in out.columns if c.startswith("log_")]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("value")) for c in logs])
    return out.select("l_orderkey", "l_linenumber", F.inline(pairs))


@query("quartile_bins", """
WITH e AS (SELECT list_distinct(list_sort([quantile_cont(p_size, 0.0), quantile_cont(p_size, 0.25),
                 quantile_cont(p_size, 0.5), quantile_cont(p_size, 0.75), quantile_cont(p_size, 1.0)])) AS ed FROM part)
SELECT p_partkey, p_size,
       CAST(CASE WHEN len(ed) >= 2 THEN len(list_filter(ed[2:len(ed) - 1], lambda x: p_size > x)) END AS INTEGER) AS p_size_bin
FROM part, e
""")
def q_quartile_bins(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return Fe.quartile_bins(p, ["p_size"])


@query("split_summary", f"""
WITH s AS (SELECT CASE WHEN {SPLIT_SQL} < 80 THEN 'train' ELSE 'test' END AS split FROM orders)
SELECT split, CAST(count(*) AS BIGINT) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM s GROUP BY split
""")
def q_split_summary(spark, sf_dir):
    return Fe.split_summary(Fe.train_test_split(table(spark, sf_dir, "orders"), "o_orderkey", 0.8, 42))


@query("class_balance", f"""
WITH s AS (SELECT o_orderstatus AS label, CASE WHEN {SPLIT_SQL} < 80 THEN 'train' ELSE 'test' END AS split FROM orders)
SELECT label, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train,
       CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test
FROM s GROUP BY label
""")
def q_class_balance(spark, sf_dir):
    s = Fe.train_test_split(table(spark, sf_dir, "orders"), "o_orderkey", 0.8, 42)
    return Fe.class_balance(s, "o_orderstatus")
