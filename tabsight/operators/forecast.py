"""ARIMA(p, 1, q) forecasts per series, fitted by Hannan–Rissanen.

The original fits ARIMA(2,1,2) by maximum likelihood on the first 80 % of one
series and forecasts the rest.  Likelihood fitting is sequential over the
whole series; Hannan–Rissanen gets consistent estimates from two least
squares regressions instead, and least squares is a sum over rows:

1. split each series by time (first int(0.8 n) rows train) and difference;
2. long AR(m) regression: the normal equations XᵀX, Xᵀy of every series
   are one grouped aggregate of lag products (lags from the ranking by ranges,
   so a dominant series is spread over many tasks);
3. residuals of that fit stand in for the unobserved shocks;
4. regress the differences on p own lags and q residual lags (again one
   grouped aggregate), solve each series' small system;
5. the forecast is a linear recursion on the state (last p differences,
   last q residuals, level); the horizon is cut into blocks, each block
   starts from the state given by a power of the transition matrix, so a
   long horizon is spread over many tasks (one row in per block).

Coefficients are therefore not the likelihood ones; same order, same split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.ordered import RANK, join_keys, ordered_rank
from tabsight.operators.series import add_lags
from tabsight.session import cut_lineage


def _normal_eq(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Per key: n, XᵀX and Xᵀy (with intercept) as arrays."""
    cols = [F.lit(1.0)] + [F.col(x) for x in xs]
    k = len(cols)
    xtx = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(k)]
    xty = [F.sum(cols[i] * F.col(y)) for i in range(k)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*xtx).alias("xtx"),
                                 F.array(*xty).alias("xty"))


def _solve(keys: list[str], k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            A = np.asarray(r["xtx"], dtype="float64").reshape(k, k)
            b = np.asarray(r["xty"], dtype="float64")
            beta = np.linalg.lstsq(A, b, rcond=None)[0]
            out.append({**{c: r[c] for c in keys}, "beta": beta.tolist()})
        return pd.DataFrame(out, columns=keys + ["beta"])
    return run


def _fit(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    ne = _normal_eq(df.dropna(subset=[y] + xs), keys, y, xs)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys) + ", beta array<double>"
    if keys:
        return ne.groupBy(*keys).applyInPandas(_solve(keys, len(xs) + 1), schema)
    return ne.mapInPandas(lambda it: (_solve([], len(xs) + 1)(p) for p in it), schema)


def _predict(beta_col: str, xs: list[str]):
    e = F.col(beta_col)[0]
    for i, x in enumerate(xs):
        e = e + F.col(beta_col)[i + 1] * F.col(x)
    return e


def _transition(beta: np.ndarray, p: int, q: int) -> np.ndarray:
    """One forecast step as a linear map of the state
    [w_t … w_{t−p+1}, e_t … e_{t−q+1}, 1, level_t] (future shocks are 0)."""
    m = p + q + 2
    M = np.zeros((m, m))
    one, lev = p + q, p + q + 1
    row = np.zeros(m)
    row[one] = beta[0]
    row[:p] = beta[1:1 + p]
    row[p:p + q] = beta[1 + p:1 + p + q]
    if p:
        M[0] = row
        for i in range(1, p):
            M[i, i - 1] = 1.0
    for j in range(1, q):
        M[p + j, p + j - 1] = 1.0
    M[one, one] = 1.0
    M[lev] = row
    M[lev, lev] += 1.0
    return M


def _forecast_block(keys: list[str], p: int, q: int, block_steps: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            beta = np.asarray(r["beta"], dtype="float64")
            hist = list(r["hist"])
            w_hist = [h["w"] for h in hist][-p:] if p else []
            e_hist = [h["e"] if h["e"] is not None else 0.0 for h in hist][-q:] if q else []
            w_hist = [0.0] * (p - len(w_hist)) + w_hist
            e_hist = [0.0] * (q - len(e_hist)) + e_hist
            z = np.array(w_hist[::-1] + e_hist[::-1] + [1.0, float(r["y_last"])])
            M = _transition(beta, p, q)
            start = int(r["__blk"]) * block_steps
            stop = min(int(r["h"]), start + block_steps)
            if start > 0:
                z = np.linalg.matrix_power(M, start) @ z
            for s in range(start + 1, stop + 1):
                z = M @ z
                out.append({**{c: r[c] for c in keys}, "step": s, "forecast": float(z[-1])})
        return pd.DataFrame(out, columns=keys + ["step", "forecast"])
    return run


def arima_forecast(df: DataFrame, keys: list[str], ts: str, val: str, p: int = 2, q: int = 2,
                   frac: float = 0.8, long_ar: int = 8, id_col: str | None = None, block_steps: int = 100_000) -> DataFrame:
    """Forecast the last (1 − frac) of every series → (keys…, step, ts,
    actual, forecast, error).  Equal times are put in order by ``id_col``
    (else by value).  A NULL key is a series like any other."""
    keys = list(keys)
    base = df.select(*keys, ts, F.col(val).cast("double").alias("__y"),
                     F.col(id_col or val).alias("__tie")).where(F.col(ts).isNotNull())
    ranked = ordered_rank(base, keys, ts, ["__tie"], with_count=True).drop("__tie")
    cut = F.floor(F.col("__n") * F.lit(frac))
    ranked = ranked.withColumn("__train", F.col(RANK) <= cut).withColumn("__cut", cut.cast("long"))
    # the stages below reuse these rows many times: cut the lineage once
    # (reliable checkpoint in the cluster's checkpoint folder)
    ranked = cut_lineage(ranked)
    POS = "__pos"
    train = ranked.where("__train").select(*keys, ts, "__y", F.col(RANK).alias(POS))
    test = ranked.where(~F.col("__train")).select(*keys, ts, "__y", (F.col(RANK) - F.col("__cut")).alias("step"))
    # 1. differences of the training part
    d1 = add_lags(train, keys, POS, "__y", 1, POS, diff=True, ts_is_rank=True).select(*keys, POS, F.col("diff_1").alias("w"))
    d1 = d1.where(F.col("w").isNotNull())
    # 2. long autoregression → residuals as shock estimates
    m = long_ar
    lw = add_lags(d1, keys, POS, "w", max(m, p), POS, diff=False, ts_is_rank=True)
    ar_x = [f"lag_{i}" for i in range(1, m + 1)]
    beta1 = _fit(lw, keys, "w", ar_x)
    res = join_keys(lw, beta1, keys)
    res = res.withColumn("e", F.col("w") - _predict("beta", ar_x)).drop("beta")
    # 3. ARMA regression on own lags and residual lags
    own = [f"wlag_{i}" for i in range(1, p + 1)]
    res = res.select(*keys, POS, "w", "e", *[F.col(f"lag_{i}").alias(f"wlag_{i}") for i in range(1, p + 1)])
    rl = add_lags(res, keys, POS, "e", q, POS, diff=False, ts_is_rank=True)
    rl = rl.select(*keys, POS, "w", *own, "e", *[F.col(f"lag_{i}").alias(f"elag_{i}") for i in range(1, q + 1)])
    xs = own + [f"elag_{i}" for i in range(1, q + 1)]
    rl = cut_lineage(rl)
    beta2 = _fit(rl, keys, "w", xs)
    # 4. state at the end of the training part (bounded: last p values, q residuals per series)
    tail = join_keys(rl, train.groupBy(*keys).agg(F.max(POS).alias("__last")), keys)
    tail = tail.where(F.col(POS) > F.col("__last") - max(p, q))
    state = tail.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(POS).alias("r"), "w", "e"))).alias("hist"))
    last_y = train.groupBy(*keys).agg(F.max_by("__y", POS).alias("y_last"))
    horizon = test.groupBy(*keys).agg(F.max("step").alias("h"))
    st = join_keys(join_keys(join_keys(state, beta2, keys), last_y, keys), horizon, keys)
    kschema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    fschema = (kschema + ", " if keys else "") + "step long, forecast double"
    # the horizon is cut into blocks of ``block_steps``; each block starts
    # from the state reached by a matrix power, so no task generates more
    # than one block whatever the horizon
    blocks = st.select("*", F.explode(F.sequence(F.lit(0), F.greatest(
        F.ceil(F.col("h") / F.lit(block_steps)) - 1, F.lit(0)).cast("int"))).alias("__blk"))
    fc = blocks.groupBy(*keys, "__blk").applyInPandas(_forecast_block(keys, p, q, block_steps), fschema)
    j = join_keys(test, fc, [*keys, "step"], "left")
    return j.select(*keys, "step", ts, F.col("__y").alias("actual"), "forecast",
                    (F.col("__y") - F.col("forecast")).alias("error"))


def forecast_scores(fc: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """R², RMSE of the forecast per series."""
    from tabsight.operators.evaluate import regression_scores
    return regression_scores(fc.withColumnRenamed("actual", "label").withColumnRenamed("forecast", "prediction"),
                             by=keys, digits=digits).select(*keys, "n", "r2", "rmse")


def forecast_table(train: DataFrame, fc: DataFrame, keys: list[str], ts: str, val: str) -> DataFrame:
    """Train rows and paired forecast rows in one long table
    (part ∈ {train, test})."""
    tr = train.select(*keys, ts, F.lit("train").alias("part"), F.col(val).cast("double").alias("actual"),
                      F.lit(None).cast("double").alias("forecast"))
    te = fc.select(*keys, ts, F.lit("test").alias("part"), "actual", "forecast")
    return tr.unionByName(te)
