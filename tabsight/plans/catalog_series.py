"""Phase 2 queries: rolling band, extremes, time split, lags, date parsing,
densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import density as D
from tabsight.operators import series as S
from tabsight.plans.registry import query, table

HOURLY_SQL = """(SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value,
                        CAST(count(*) AS BIGINT) AS n_obs FROM events GROUP BY 1, 2)"""


def hourly(spark, sf_dir):
    return S.resample_mean(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", "hour")


@query("rolling_band", f"""
WITH h AS {HOURLY_SQL},
r AS (SELECT *, count(value) OVER w AS k, avg(value) OVER w AS ma, stddev_samp(value) OVER w AS sd
      FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT event_type, ts, round(value, 6) AS value, n_obs,
       round(CASE WHEN k = 30 THEN ma END, 6) AS ma, round(CASE WHEN k = 30 THEN sd END, 6) AS std,
       round(CASE WHEN k = 30 THEN ma - sd END, 6) AS band_lo, round(CASE WHEN k = 30 THEN ma + sd END, 6) AS band_hi
FROM r
""")
def q_rolling_band(spark, sf_dir):
    h = hourly(spark, sf_dir)
    out = S.rolling_stats(h, ["event_type"], "ts", "value", 30, "ts")
    return out.withColumn("value", F.round("value", 6))


@query("peak_and_low", f"""
WITH h AS {HOURLY_SQL}
SELECT event_type, round(max(value), 6) AS peak_value, arg_min(ts, [-value, epoch_us(ts)]) AS peak_ts,
       round(min(value), 6) AS low_value, arg_min(ts, [value, epoch_us(ts)]) AS low_ts
FROM h GROUP BY event_type
""")
def q_peak_and_low(spark, sf_dir):
    out = S.peak_and_low(hourly(spark, sf_dir), ["event_type"], "ts", "value", "ts")
    return out.withColumn("peak_value", F.round("peak_value", 6)).withColumn("low_value", F.round("low_value", 6))


@query("time_split", f"""
WITH h AS {HOURLY_SQL},
r AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn,
             count(*) OVER (PARTITION BY event_type) AS n FROM h)
SELECT event_type, ts, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split,
       CAST(CASE WHEN rn <= floor(n * 0.8) THEN rn ELSE rn - floor(n * 0.8) END AS BIGINT) AS step
FROM r
""")
def q_time_split(spark, sf_dir):
    return S.time_split(hourly(spark, sf_dir), ["event_type"], "ts", "ts", 0.8).select(
        "event_type", "ts", "split", "step")


@query("lags_and_diff", f"""
WITH h AS {HOURLY_SQL}
SELECT event_type, ts, round(value, 6) AS value,
       round(lag(value, 1) OVER w, 6) AS lag_1, round(lag(value, 2) OVER w, 6) AS lag_2,
       round(value - lag(value, 1) OVER w, 6) AS diff_1
FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts)
""")
def q_lags_and_diff(spark, sf_dir):
    out = S.add_lags(hourly(spark, sf_dir), ["event_type"], "ts", "value", 2, "ts", diff=True)
    return out.select("event_type", "ts", *[F.round(c, 6).alias(c) for c in ["value", "lag_1", "lag_2", "diff_1"]])


@query("parse_date", """
SELECT o_orderkey, parsed FROM (
  SELECT o_orderkey,
         try_strptime(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END,
                      '%Y-%m-%d %H:%M:%S') AS parsed FROM orders) t
WHERE parsed IS NOT NULL
""")
def q_parse_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    txt = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit("x"))
                   .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("date_text"))
    parsed = S.parse_date(txt, "date_text", "parsed", "yyyy-MM-dd HH:mm:ss")
    return parsed.where(F.col("parsed").isNotNull()).select("o_orderkey", F.col("parsed").cast("timestamp_ntz"))


def _kde_sql(tbl, col, points, digits=8):
    return f"""
WITH s AS (SELECT count({col}) AS n, min({col}) AS lo, max({col}) AS hi, stddev_samp({col}) AS sd FROM {tbl}),
g AS (SELECT CAST(range AS INTEGER) AS point FROM range({points})),
p AS (SELECT point, lo + point * ((hi - lo) / {points - 1}) AS x, n, sd * pow(n, -0.2) AS h FROM g, s)
SELECT point, round(x, 6) AS x,
       round(sum(exp(-0.5 * pow((x - v.{col}) / h, 2))) / (n * h * sqrt(2 * pi())), {digits}) AS density
FROM p, (SELECT {col} FROM {tbl} WHERE {col} IS NOT NULL) v GROUP BY point, x, n, h"""


@query("kde_grid", _kde_sql("events", "value", 300))
def q_kde_grid(spark, sf_dir):
    return D.kde(table(spark, sf_dir, "events"), "value", 300)


@query("violin_density", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", * FROM ({_kde_sql('lineitem', c, 100)})" for c in ["l_quantity", "l_discount"]))
def q_violin_density(spark, sf_dir):
    return D.violin_density(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 100)


@query("arima_forecast")
def q_arima_forecast(spark, sf_dir):
    """ARIMA(2,1,2) by Hannan–Rissanen on the first 80 % of every hourly
    ``event_type`` series; forecast paired with the held-out hours."""
    from tabsight.operators.forecast import arima_forecast
    fc = arima_forecast(hourly(spark, sf_dir), ["event_type"], "ts", "value", 2, 2, 0.8, id_col="ts")
    return fc.select("event_type", "step", "ts", F.round("actual", 6).alias("actual"),
                     F.round("forecast", 6).alias("forecast"), F.round("error", 6).alias("error"))


@query("arima_ml_fit")
def q_arima_ml_fit(spark, sf_dir):
    """ARIMA(2,1,2) by maximum likelihood on every hourly ``event_type``
    series: coefficients, variance and log-likelihood."""
    from tabsight.operators.arima_ml import arima_fit
    fits = arima_fit(hourly(spark, sf_dir), ["event_type"], "ts", "value", 2, 2, id_col="ts")
    return fits.select("event_type", "n_diff", *[F.round(F.col(c)[i], 3).alias(f"{c}{i + 1}") for c in ("ar", "ma") for i in (0, 1)],
                       F.round("sigma2", 4).alias("sigma2"), F.round("log_likelihood", 2).alias("log_likelihood"))


@query("arima_ml_check", f"""
WITH h AS {HOURLY_SQL}
SELECT event_type, count(*) - 1 AS n_diff, true AS not_below_least_squares FROM h GROUP BY event_type
""")
def q_arima_ml_check(spark, sf_dir):
    """Differences used by each fit, and whether its likelihood is at least
    that of the least-squares start."""
    from tabsight.operators.arima_ml import arima_fit
    fits = arima_fit(hourly(spark, sf_dir), ["event_type"], "ts", "value", 2, 2, id_col="ts")
    return fits.select("event_type", "n_diff",
                       (F.col("log_likelihood") >= F.col("start_log_likelihood") - 1e-9).alias("not_below_least_squares"))


@query("arima_ml_forecast")
def q_arima_ml_forecast(spark, sf_dir):
    """ARIMA(2,1,2) by maximum likelihood on the first 80 % of every hourly
    series; forecast paired with the held-out hours."""
    from tabsight.operators.arima_ml import arima_ml_forecast
    fc = arima_ml_forecast(hourly(spark, sf_dir), ["event_type"], "ts", "value", 2, 2, 0.8, id_col="ts")
    return fc.select("event_type", "step", "ts", F.round("actual", 6).alias("actual"),
                     F.round("forecast", 3).alias("forecast"), F.round("error", 3).alias("error"))


@query("forecast_scores")
def q_forecast_scores(spark, sf_dir):
    from tabsight.operators.forecast import arima_forecast, forecast_scores
    fc = arima_forecast(hourly(spark, sf_dir), ["event_type"], "ts", "value", 2, 2, 0.8, id_col="ts")
    return forecast_scores(fc, ["event_type"])


@query("forecast_table")
def q_forecast_table(spark, sf_dir):
    """Training hours and held-out hours with their forecasts in one
    long table per ``event_type`` (part = train / test)."""
    from tabsight.operators.forecast import arima_forecast, forecast_table
    from tabsight.operators.series import time_split
    h = hourly(spark, sf_dir)
    fc = arima_forecast(h, ["event_type"], "ts", "value", 2, 2, 0.8, id_col="ts")
    train = time_split(h, ["event_type"], "ts", "ts", 0.8).where(F.col("split") == "train")
    out = forecast_table(train, fc, ["event_type"], "ts", "value")
    return out.select("event_type", "ts", "part", F.round("actual", 6).alias("actual"),
                      F.round("forecast", 6).alias("forecast"))


@query("series_overview", """
WITH o AS (SELECT o_orderdate AS ts, o_orderkey, o_totalprice AS value FROM orders),
r AS (SELECT *, count(value) OVER w AS k, avg(value) OVER w AS ma, stddev_samp(value) OVER w AS sd FROM o
      WINDOW w AS (ORDER BY ts, o_orderkey ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT o_orderkey, round(CASE WHEN k = 30 THEN ma END, 4) AS ma, round(CASE WHEN k = 30 THEN sd END, 0) AS std,
       value = (SELECT max(value) FROM o) AS is_peak, value = (SELECT min(value) FROM o) AS is_low FROM r
""")
def q_series_overview(spark, sf_dir):
    """R1 on order totals: the date arrives as text and is parsed; rolling
    band of 30 orders and whether an order is the peak or the low."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))
    band, ends = S.series_overview(o, [], "day", "o_totalprice", "o_orderkey", 30, "yyyy-MM-dd HH:mm:ss")
    return band.crossJoin(F.broadcast(ends)).select(  # one row of extremes
        "o_orderkey", F.round("ma", 4).alias("ma"), F.round("std", 0).alias("std"),
        (F.col("o_totalprice") == F.col("peak_value")).alias("is_peak"), (F.col("o_totalprice") == F.col("low_value")).alias("is_low"))


@query("series_overview_by_key", """
WITH c AS (SELECT *, CAST(greatest(2, least(30, n // 8)) AS INTEGER) AS w FROM (
  SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS cust, o_orderdate AS ts,
         o_totalprice AS value, count(*) OVER (PARTITION BY CASE WHEN o_custkey % 3 = 0 THEN o_custkey END) AS n FROM orders)),
r AS (SELECT *, count(value) OVER f AS k, avg(value) OVER f AS ma FROM c
      WINDOW f AS (PARTITION BY cust ORDER BY ts, o_orderkey ROWS BETWEEN w - 1 PRECEDING AND CURRENT ROW))
SELECT o_orderkey, w, round(CASE WHEN k = w THEN ma END, 4) AS ma FROM r
""")
def q_series_overview_by_key(spark, sf_dir):
    """R1 with a rolling width per key: the orders of every third customer
    are short series of their own, all others one long series."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("cust"),
                                              "o_orderdate", "o_totalprice")
    band, _ = S.series_overview(o, ["cust"], "o_orderdate", "o_totalprice", "o_orderkey")
    return band.select("o_orderkey", "w", F.round("ma", 4).alias("ma"))


@query("forecast_leaderboard")
def q_forecast_leaderboard(spark, sf_dir):
    """The ARIMA forecasts (least squares, maximum likelihood) as rows of
    the leaderboard next to a "last value" and a "train mean" forecast of the
    same held-out hours."""
    from tabsight.operators.evaluate import leaderboard, regression_scores
    from tabsight.operators.arima_ml import arima_ml_forecast
    from tabsight.operators.forecast import arima_forecast
    h = hourly(spark, sf_dir)
    fc = arima_forecast(h, ["event_type"], "ts", "value", 2, 2, 0.8, id_col="ts")
    ml = arima_ml_forecast(h, ["event_type"], "ts", "value", 2, 2, 0.8, id_col="ts")
    fc = fc.join(ml.select("event_type", "ts", F.col("forecast").alias("likely")), ["event_type", "ts"])
    train = S.time_split(h, ["event_type"], "ts", "ts", 0.8).where(F.col("split") == "train")
    base = train.groupBy("event_type").agg(F.max_by("value", "ts").alias("last"), F.avg("value").alias("mean"))
    both = fc.join(base, "event_type").select("event_type", "ts", F.col("actual").alias("label"), F.inline(F.array(
        F.struct(F.lit("ARIMA(2,1,2)").alias("model"), F.col("forecast").alias("prediction")),
        F.struct(F.lit("ARIMA(2,1,2) by likelihood").alias("model"), F.col("likely").alias("prediction")),
        F.struct(F.lit("last value").alias("model"), F.col("last").alias("prediction")),
        F.struct(F.lit("train mean").alias("model"), F.col("mean").alias("prediction")))))
    scores = regression_scores(both, by=["model"]).select("model", "r2", "rmse")
    return leaderboard(scores, "r2").select("rank", "model", "r2", "rmse", "medal")
