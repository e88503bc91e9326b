"""ARIMA(p, 1, q) by maximum likelihood (R2).

The differences w follow an ARMA(p, q) without a constant, in state-space form
with r = max(p, q + 1) states that starts in its stationary distribution.  The
Kalman gains do not depend on the data, so a stretch of a series acts on the
state that enters it as an affine map, and its part of the likelihood is a
quadratic form in that state:

    state out = A a + b,      sum of v^2 / S = c0 + 2 c1.a + a' C2 a

Such elements (A, b, c0, c1, C2, log S) of neighbouring stretches join into
the element of both, and joining is associative.  A stretch is therefore cut
into lanes that are filtered side by side in NumPy, and a long series into
blocks that are filtered by different tasks, in one pass for all parameter
vectors that the optimiser asks for at once.

Each series has its own optimiser (BFGS on parameters whose partial
autocorrelations stay inside +-``EDGE``, started at the least-squares solution
and at zero).  A series of up to ``block_rows`` differences is fitted in one
task; for longer ones the driver keeps the optimisers (a few numbers for each
series of more than ``block_rows`` rows) and each of their steps is one job
over the blocks of all long series.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.ordered import RANK, join_keys, ordered_rank
from tabsight.session import cut_lineage, ship_package

EDGE = 0.998  # largest partial autocorrelation of the AR and the MA part
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 2.0)  # of a line search, tried in one pass


# ----------------------------------------------------------------- parameters
def coefficients(x: np.ndarray) -> np.ndarray:
    """Unbounded numbers -> coefficients of a stationary autoregression, by
    the Durbin-Levinson recursion on their partial autocorrelations."""
    out = np.zeros(0)
    for r in EDGE * x / np.sqrt(1 + x * x):
        out = np.append(out - r * out[::-1], r)
    return out


def unbounded(coef: np.ndarray) -> np.ndarray:
    """The inverse; partial autocorrelations beyond the edge are moved inside."""
    pacf, c = [], np.array(coef, float)
    while len(c):
        r = float(np.clip(c[-1], -0.98, 0.98))
        pacf.append(r)
        c = (c[:-1] + r * c[:-1][::-1]) / (1 - r * r)
    u = np.array(pacf[::-1]) / EDGE
    return u / np.sqrt(1 - u * u)


def split_parameters(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(AR, MA) coefficients; the MA part 1 + theta_1 z + ... is invertible."""
    return coefficients(x[:p]), -coefficients(x[p:])


def least_squares_start(w: np.ndarray, p: int, q: int, long_ar: int = 8) -> np.ndarray | None:
    """Hannan-Rissanen estimates as unbounded parameters; None if too short."""
    m = min(long_ar, len(w) // 4)
    if m < 1 or len(w) < m + max(p, q) + 2 * (p + q) + 2:
        return None

    def lagged(z: np.ndarray, k: int, first: int) -> np.ndarray:
        return np.stack([z[first - i:len(z) - i] for i in range(1, k + 1)], axis=1) if k else np.zeros((len(z) - first, 0))
    x = lagged(w, m, m)
    e = np.concatenate([np.zeros(m), w[m:] - x @ np.linalg.lstsq(x, w[m:], rcond=None)[0]])
    first = m + max(p, q)
    x = np.hstack([lagged(w, p, first), lagged(e, q, first)])
    beta = np.linalg.lstsq(x, w[first:], rcond=None)[0]
    if not np.isfinite(beta).all():
        return None
    return np.concatenate([unbounded(beta[:p]), unbounded(-beta[p:])])


# --------------------------------------------------------------------- filter
def _gains(phi: np.ndarray, load: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(K, S) of the filter's first steps for each parameter set, until they
    no longer change (the last ones then hold for good) or ``limit`` steps."""
    sets, r = phi.shape
    f = np.zeros((sets, r, r))
    f[:, :, 0] = phi
    f[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    q = load[:, :, None] * load[:, None, :]
    kron = np.einsum("sij,skl->sikjl", f, f).reshape(sets, r * r, r * r)
    state = np.linalg.solve(np.eye(r * r) - kron, q.reshape(sets, r * r, 1)).reshape(sets, r, r)
    ks, vs = [], []
    while True:
        v = state[:, 0, 0]
        k = np.einsum("sij,sj->si", f, state[:, :, 0]) / v[:, None]
        ks.append(k)
        vs.append(v)
        new = f @ state @ f.transpose(0, 2, 1) + q - k[:, :, None] * k[:, None, :] * v[:, None, None]
        new = (new + new.transpose(0, 2, 1)) / 2
        if len(vs) >= limit or np.abs(new - state).max() <= 1e-13 * max(1.0, np.abs(state).max()):
            return np.stack(ks, axis=1), np.stack(vs, axis=1)
        state = new


class Element:
    """Stretches of a series under several parameter sets (first axis)."""

    def __init__(self, a, b, c0, c1, c2, log_s, n):
        self.a, self.b, self.c0, self.c1, self.c2, self.log_s, self.n = a, b, c0, c1, c2, log_s, n

    def then(self, other: Element) -> Element:
        """This stretch followed by ``other``."""
        turn = self.a.transpose(0, 2, 1)
        cb = np.einsum("sij,sj->si", other.c2, self.b)
        return Element(
            other.a @ self.a, np.einsum("sij,sj->si", other.a, self.b) + other.b,
            self.c0 + other.c0 + 2 * (other.c1 * self.b).sum(1) + (cb * self.b).sum(1),
            self.c1 + np.einsum("sij,sj->si", turn, other.c1 + cb), self.c2 + turn @ other.c2 @ self.a,
            self.log_s + other.log_s, self.n + other.n)

    def flat(self) -> np.ndarray:
        """sets x numbers"""
        s = len(self.c0)
        return np.hstack([self.a.reshape(s, -1), self.b, self.c0[:, None], self.c1, self.c2.reshape(s, -1),
                          self.log_s[:, None], np.full((s, 1), float(self.n))])

    @classmethod
    def from_flat(cls, x: np.ndarray, r: int) -> Element:
        s, at = len(x), np.cumsum([r * r, r, 1, r, r * r, 1])
        a, b, c0, c1, c2, log_s, n = np.split(x, at, axis=1)
        return cls(a.reshape(s, r, r), b, c0[:, 0], c1, c2.reshape(s, r, r), log_s[:, 0], float(n[0, 0]))

    def log_likelihood(self) -> np.ndarray:
        """Per parameter set, at the best variance; the state enters at 0."""
        return -0.5 * (self.n * (np.log(2 * np.pi) + 1 + np.log(self.variance())) + self.log_s)

    def variance(self) -> np.ndarray:
        return np.maximum(self.c0, 1e-300) / self.n


def element(w: np.ndarray, first: int, x: np.ndarray, p: int, q: int) -> Element:
    """Element of the differences w (number ``first`` and on of their series)
    for each row of ``x``, lanes of about sqrt(n) steps side by side."""
    sets, n, r = len(x), len(w), max(p, q + 1)
    phi, load = np.zeros((sets, r)), np.zeros((sets, r))
    for s in range(sets):
        ar, ma = split_parameters(x[s], p)
        phi[s, :p], load[s, 0], load[s, 1:q + 1] = ar, 1.0, ma
    k_all, v_all = _gains(phi, load, first + n)
    lanes = max(1, int(np.sqrt(n)))
    steps = -(-n // lanes)
    lanes = -(-n // steps)
    padded = np.zeros(lanes * steps)
    padded[:n] = w
    y = padded.reshape(lanes, steps)
    at = np.arange(lanes) * steps
    a, turn = np.zeros((sets, lanes, r)), np.tile(np.eye(r), (sets, lanes, 1, 1))
    c0, c1, c2 = np.zeros((sets, lanes)), np.zeros((sets, lanes, r)), np.zeros((sets, lanes, r, r))
    log_s = np.zeros((sets, lanes))
    ph = phi[:, None, :]
    for t in range(steps):
        live = at + t < n
        spot = np.minimum(first + at + t, v_all.shape[1] - 1)
        k, v = k_all[:, spot], v_all[:, spot]
        g, err = turn[:, :, 0, :], y[:, t] - a[:, :, 0]
        weight = live / v
        c0 += err * err * weight
        c1 -= (err * weight)[..., None] * g
        c2 += weight[..., None, None] * g[..., :, None] * g[..., None, :]
        log_s += live * np.log(v)
        new = ph * a[:, :, :1] + k * err[..., None]
        new[:, :, :-1] += a[:, :, 1:]
        new_turn = (ph - k)[..., None] * g[:, :, None, :]
        new_turn[:, :, :-1] += turn[:, :, 1:]
        if live.all():
            a, turn = new, new_turn
        else:
            a, turn = np.where(live[:, None], new, a), np.where(live[:, None, None], new_turn, turn)
    out = None
    for i in range(lanes):
        own = Element(turn[:, i], a[:, i], c0[:, i], c1[:, i], c2[:, i], log_s[:, i], int(min(steps, n - i * steps)))
        out = own if out is None else out.then(own)
    return out


# ------------------------------------------------------------------ optimiser
def bfgs(starts: list[np.ndarray], rounds: int = 60, tol: float = 1e-10) -> Generator[np.ndarray, np.ndarray, tuple]:
    """Minimise by asking: yields points (rows) and is sent their values.
    Ends with (point, value, values of the starts); never above a start."""
    h = 1e-5
    first = yield np.array(starts)
    x, f, m = starts[int(np.argmin(first))], float(np.min(first)), len(starts[0])
    if not m:
        return x, f, first

    def around(at: np.ndarray) -> np.ndarray:
        return np.vstack([at + h * np.eye(m), at - h * np.eye(m)])
    both = yield around(x)
    g, inverse, plain = (both[:m] - both[m:]) / (2 * h), np.eye(m), True
    for _ in range(rounds):
        direction = -inverse @ g
        if direction @ g >= 0:
            direction, inverse, plain = -g, np.eye(m), True
        direction = direction * min(1.0, 5.0 / max(1e-300, np.abs(direction).max()))
        points = x + np.array(STEPS)[:, None] * direction
        values = yield points
        best = int(np.nanargmin(values)) if np.isfinite(values).any() else 0
        if not values[best] < f - tol * (1 + abs(f)):
            if plain:
                break
            inverse, plain = np.eye(m), True
            continue
        both = yield around(points[best])
        new_g = (both[:m] - both[m:]) / (2 * h)
        s, y = points[best] - x, new_g - g
        if s @ y > 1e-12:
            turn = np.eye(m) - np.outer(s, y) / (s @ y)
            inverse = turn @ inverse @ turn.T + np.outer(s, s) / (s @ y)
            plain = False
        x, f, g = points[best], float(values[best]), new_g
    return x, f, first


def _starts(w: np.ndarray, p: int, q: int) -> list[np.ndarray]:
    start = least_squares_start(w, p, q)
    return ([start] if start is not None else []) + [np.zeros(p + q)]


def _result(x: np.ndarray, whole: Element, first: np.ndarray, p: int) -> dict:
    ar, ma = split_parameters(x, p)
    return {"ar": ar.tolist(), "ma": ma.tolist(), "sigma2": float(whole.variance()[0]),
            "log_likelihood": float(whole.log_likelihood()[0]), "start_log_likelihood": -float(first[0]) * whole.n,
            "n_diff": int(whole.n), "state": whole.b[0].tolist()}


RESULT = ("ar array<double>, ma array<double>, sigma2 double, log_likelihood double, start_log_likelihood double, "
          "n_diff long, state array<double>")


def fit_series(w: np.ndarray, p: int, q: int) -> dict:
    """Maximum-likelihood fit of one series of differences."""
    search = bfgs(_starts(w, p, q))
    points = next(search)
    while True:
        whole = element(w, 0, points, p, q)
        try:
            points = search.send(-whole.log_likelihood() / whole.n)
        except StopIteration as end:
            x, _, first = end.value
            return _result(x, element(w, 0, x[None], p, q), first, p)


# --------------------------------------------------------------- Spark plumbing
def difference_blocks(train: DataFrame, keys: list[str], pos: str, y: str, block_rows: int) -> DataFrame:
    """(keys…, blk, w): the differences of each series in order, in arrays of
    at most ``block_rows``; missing values must have been left out."""
    block = F.floor((F.col(pos) - 1) / block_rows)
    # the first value of a block is also needed behind the last of the block before
    home = F.when((F.col(pos) - 1) % block_rows == 0, F.array(block, block - 1)).otherwise(F.array(block))
    rows = train.select(*keys, pos, y, F.explode(home).alias("blk")).where("blk >= 0")
    made = rows.groupBy(*keys, "blk").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("i"), F.col(y).alias("y")))).alias("v"))
    w = F.zip_with(F.slice("v", 2, F.size("v")), F.slice("v", 1, F.size("v") - 1), lambda b, a: b["y"] - a["y"])
    return made.where("size(v) > 1").select(*keys, F.col("blk").cast("long").alias("blk"), w.alias("w"))


def _local(p: int, q: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = [fit_series(np.asarray(w, float), p, q) for w in b["w"]]
            yield pd.concat([b.drop(columns=["w", "blk"]).reset_index(drop=True),
                             pd.DataFrame(fits, columns=[c.split()[0] for c in RESULT.split(", ")])], axis=1)
    return run


def _block_elements(asked: dict[int, np.ndarray], block_rows: int, p: int, q: int):
    """One element per parameter set for each stretch of neighbouring blocks
    of a series in the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, series, first, last = [], None, None, None
        so_far = None

        def close():
            if so_far is not None:
                done.extend((series, first, k, row.tolist()) for k, row in enumerate(so_far.flat()))
        for batch in batches:
            for s, blk, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if s not in asked:
                    continue
                own = element(w.values.to_numpy(zero_copy_only=False), blk * block_rows, asked[s], p, q)
                if s == series and blk == last + 1:
                    so_far = so_far.then(own)
                else:
                    close()
                    series, first, so_far = s, blk, own
                last = blk
        close()
        cols = list(zip(*done)) if done else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
            pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64())))], names=["series", "blk", "k", "x"])
    return run


def _fit_long(blocks: DataFrame, keys: list[str], block_rows: int, p: int, q: int) -> DataFrame:
    """Fits of the series of more than one block."""
    spark, r = blocks.sparkSession, max(p, q + 1)
    names = blocks.select(*keys).distinct().withColumn("series", F.monotonically_increasing_id())
    names = cut_lineage(names)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(join_keys(blocks, names, keys).select("series", "blk", "w")
                         .repartitionByRange(parts, "series", "blk").sortWithinPartitions("series", "blk"))
    searches, points = {}, {}
    for row in placed.where("blk = 0").toLocalIterator():  # the start is taken from each series' first block
        searches[row["series"]] = bfgs(_starts(np.asarray(row["w"], float), p, q))
        points[row["series"]] = next(searches[row["series"]])

    def evaluate(asked: dict[int, np.ndarray]) -> dict[int, Element]:
        rows = placed.mapInArrow(_block_elements(asked, block_rows, p, q), "series long, blk long, k int, x array<double>").collect()
        found: dict[int, dict[int, list]] = {}
        for row in rows:
            found.setdefault(row["series"], {}).setdefault(row["blk"], []).append((row["k"], row["x"]))
        out = {}
        for series, by_block in found.items():
            for blk in sorted(by_block):
                own = Element.from_flat(np.array([x for _, x in sorted(by_block[blk])]), r)
                out[series] = out[series].then(own) if series in out else own
        return out
    ended = {}
    while points:
        for series, whole in evaluate(points).items():
            try:
                points[series] = searches[series].send(-whole.log_likelihood() / whole.n)
            except StopIteration as end:
                ended[series] = end.value
                del points[series]
    final = evaluate({s: x[None] for s, (x, _, _) in ended.items()}) if ended else {}
    rows = [(s, *_result(ended[s][0], whole, ended[s][2], p).values()) for s, whole in final.items()]
    return join_keys(names.withColumnRenamed("series", "__s"),
                     spark.createDataFrame(rows, "__s long, " + RESULT), ["__s"]).drop("__s")


def _ranked(df: DataFrame, keys: list[str], ts: str, val: str, frac: float, id_col: str | None) -> DataFrame:
    base = df.select(*keys, ts, F.col(val).cast("double").alias("__y"), F.col(id_col or val).alias("__tie"))
    base = base.where(F.col(ts).isNotNull() & F.col("__y").isNotNull() & ~F.isnan("__y"))
    ranked = ordered_rank(base, keys, ts, ["__tie"]).drop("__tie")
    return cut_lineage(ranked.withColumn("__cut", F.floor(F.col("__n") * F.lit(frac)).cast("long")))


def _fit_ranked(ranked: DataFrame, keys: list[str], p: int, q: int, block_rows: int) -> DataFrame:
    ship_package(ranked.sparkSession)
    train = ranked.where(F.col(RANK) <= F.col("__cut"))
    blocks = difference_blocks(train.select(*keys, RANK, "__y", "__cut"), keys, RANK, "__y", block_rows)
    blocks = cut_lineage(blocks)
    long = blocks.where("blk > 0").select(*keys).distinct()
    some_long = not long.isEmpty()
    short = blocks
    if some_long:
        marked = join_keys(blocks, long.withColumn("__long", F.lit(True)), keys, "left")
        short, many = marked.where("__long IS NULL").drop("__long"), marked.where("__long").drop("__long")
    schema = "".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}, " for c in keys) + RESULT
    parts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = short.repartition(max(parts, 1), *keys, "blk").mapInPandas(_local(p, q), schema)
    return cut_lineage(fits.unionByName(_fit_long(many, keys, block_rows, p, q)) if some_long else fits)


def arima_fit(df: DataFrame, keys: list[str], ts: str, val: str, p: int = 2, q: int = 2, frac: float = 1.0,
              id_col: str | None = None, block_rows: int = 100_000) -> DataFrame:
    """(keys…, ar, ma, sigma2, log_likelihood, start_log_likelihood, n_diff,
    state) of every series with two values or more in its first ``frac``.

    Rows with a missing time or value are left out; equal times are put in
    order by ``id_col`` (else by value); a NULL key is a series like any
    other.  ``start_log_likelihood`` belongs to the least-squares start (to
    zero coefficients for series too short for it); ``state`` is the state
    behind the last difference."""
    return _fit_ranked(_ranked(df, list(keys), ts, val, frac, id_col), list(keys), p, q, block_rows)


def _forecast_block(keys: list[str], p: int, block_steps: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                state = np.asarray(row["state"], float)
                r = len(state)
                move = np.zeros((r + 1, r + 1))  # of (state, level)
                move[:p, 0] = np.asarray(row["ar"], float)
                move[np.arange(r - 1), np.arange(1, r)] = 1.0
                move[r, 0] = move[r, r] = 1.0
                start = int(row["__blk"]) * block_steps
                z = np.linalg.matrix_power(move, start) @ np.append(state, row["y_last"])
                levels = []
                for _ in range(start, min(int(row["h"]), start + block_steps)):
                    z = move @ z
                    levels.append(z[r])
                out = pd.DataFrame({"step": np.arange(start + 1, start + 1 + len(levels)), "forecast": levels})
                for c in reversed(keys):
                    out.insert(0, c, [row[c]] * len(out))
                yield out
    return run


def arima_ml_forecast(df: DataFrame, keys: list[str], ts: str, val: str, p: int = 2, q: int = 2, frac: float = 0.8,
                      id_col: str | None = None, block_rows: int = 100_000, block_steps: int = 100_000) -> DataFrame:
    """Forecast the last (1 - frac) of every series -> (keys…, step, ts,
    actual, forecast, error); a series whose first part has fewer than two
    values has no forecast.  Long horizons are cut into blocks that start
    from a power of the transition."""
    keys = list(keys)
    ranked = _ranked(df, keys, ts, val, frac, id_col)
    fits = _fit_ranked(ranked, keys, p, q, block_rows)
    test = ranked.where(F.col(RANK) > F.col("__cut")).select(*keys, ts, "__y", (F.col(RANK) - F.col("__cut")).alias("step"))
    last = ranked.where(F.col(RANK) <= F.col("__cut")).groupBy(*keys).agg(F.max_by("__y", RANK).alias("y_last"))
    horizon = test.groupBy(*keys).agg(F.max("step").alias("h"))
    st = join_keys(join_keys(fits.select(*keys, "ar", "state"), last, keys), horizon, keys)
    blocks = st.select("*", F.explode(F.sequence(F.lit(0), F.greatest(
        F.ceil(F.col("h") / F.lit(block_steps)) - 1, F.lit(0)).cast("int"))).alias("__blk"))
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys) + "step long, forecast double"
    fc = blocks.mapInPandas(_forecast_block(keys, p, block_steps), schema)
    return join_keys(test, fc, [*keys, "step"], "left").select(
        *keys, "step", ts, F.col("__y").alias("actual"), "forecast", (F.col("__y") - F.col("forecast")).alias("error"))
