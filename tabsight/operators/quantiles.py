"""Exact quantiles without gathering a column in one task.

Spark's exact ``percentile`` keeps a value→count map of the whole column in
its final merge: fine for millions of rows, not for a 100 TB column.  The
sketch ``percentile_approx`` is bounded but approximate.  ``exact_quantiles``
is exact and bounded, and works alike at every size:

1. one aggregate: non-missing count and, for each rank the interpolation
   needs, a pair of sketch quantiles a little below and above it;
2. one aggregate: how many values lie below and inside each such interval.
   The interval that holds the rank is either small (at most ``max_inside``
   values) or a single value, or it is cut by a sketch of its own values in
   the same way (each round leaves about 4 / accuracy of the values);
3. the values of the small intervals are counted by value, a bounded table,
   and the order statistics are read from it.

Two or three scans of the needed columns for up to 10^8 rows, two more for
each further factor of about 2,500.  Infinite values are ordinary values;
NaN counts as missing.  Interpolation is linear, as in ``percentile``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, cols: dict, probs, max_inside: int = 100_000, accuracy: int = ACCURACY) -> dict:
    """``cols``: name → numeric Column (NaN already NULL).  Returns
    {(name, p): value or None} with linear interpolation.  One aggregate
    gathers at most ``max_inside`` values for each open rank."""
    names = list(cols)
    vals = df.select(*[cols[n].cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    probs = [float(p) for p in probs]
    around = [min(1.0, max(0.0, p + e)) for p in probs for e in (-2 / accuracy, 2 / accuracy)]
    first = vals.agg(*[e for i in range(len(names)) for e in (
        F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}"),
        F.percentile_approx(f"c{i}", F.array(*map(F.lit, around)), accuracy).alias(f"s{i}"))]).first()

    plan: dict[tuple[str, float], tuple | None] = {}
    # (column, 0-based rank) -> [lo, hi, outer lo, outer hi]: the guess and what surely holds the rank
    guess: dict[tuple[int, int], list] = {}
    for i, name in enumerate(names):
        n = first[f"n{i}"]
        for j, p in enumerate(probs):
            if not n:
                plan[(name, p)] = None
                continue
            h = (n - 1) * p
            k0, k1 = math.floor(h), min(math.floor(h) + 1, n - 1)
            plan[(name, p)] = (i, k0, k1, h)
            lo, hi = first[f"s{i}"][2 * j], first[f"s{i}"][2 * j + 1]
            lo = first[f"lo{i}"] if around[2 * j] == 0.0 else lo
            hi = first[f"hi{i}"] if around[2 * j + 1] == 1.0 else hi
            for k in (k0, k1):
                guess.setdefault((i, k), [lo, hi, first[f"lo{i}"], first[f"hi{i}"]])

    done: dict[tuple[int, int], float] = {}
    small: dict[tuple[int, int], tuple] = {}
    while guess:
        spans = sorted({(t[0], s[0], s[1]) for t, s in guess.items()})
        got = vals.agg(*[e for j, (c, lo, hi) in enumerate(spans) for e in (
            F.count_if(F.col(f"c{c}") < lo).alias(f"b{j}"),
            F.count_if(F.col(f"c{c}").between(lo, hi)).alias(f"i{j}"))]).first()
        cut: dict[tuple[int, float, float], list] = {}
        for t, s in list(guess.items()):
            j = spans.index((t[0], s[0], s[1]))
            below, inside = got[f"b{j}"], got[f"i{j}"]
            if t[1] < below:  # the sketch missed the rank: what it left out below holds it
                edge = math.nextafter(s[0], -math.inf)
                s[0], s[1], s[3] = s[2], edge, edge
            elif t[1] >= below + inside:
                edge = math.nextafter(s[1], math.inf)
                s[0], s[1], s[2] = edge, s[3], edge
            elif s[0] == s[1]:
                done[t] = s[0]
                del guess[t]
            elif inside <= max_inside:
                small[t] = (s[0], s[1], below)
                del guess[t]
            else:
                cut.setdefault((t[0], s[0], s[1]), []).append((t, (t[1] - below) / (inside - 1)))
        if cut:
            spans = list(cut)
            sketch = vals.agg(*[F.percentile_approx(
                F.when(F.col(f"c{c}").between(lo, hi), F.col(f"c{c}")),
                F.array(*[F.lit(min(1.0, max(0.0, p + e))) for _, p in cut[(c, lo, hi)] for e in (
                    -2 / accuracy, 2 / accuracy)]), accuracy).alias(f"s{j}")
                for j, (c, lo, hi) in enumerate(spans)]).first()
            for j, span in enumerate(spans):
                for m, (t, p) in enumerate(cut[span]):
                    lo, hi = sketch[f"s{j}"][2 * m], sketch[f"s{j}"][2 * m + 1]
                    if (lo, hi) == (guess[t][0], guess[t][1]):  # two heavy values: look at one of them
                        hi = lo
                    guess[t] = [lo, hi, span[1], span[2]]
    if small:
        spans = sorted({(t[0], lo, hi) for t, (lo, hi, _) in small.items()})
        inside = F.array(*[F.when(F.col(f"c{c}").between(lo, hi), F.struct(F.lit(j).alias("j"), F.col(f"c{c}").alias("x")))
                           for j, (c, lo, hi) in enumerate(spans)])
        rows = (vals.select(F.inline(F.filter(inside, lambda s: s.isNotNull()))).groupBy("j", "x").count()
                .collect())  # at most max_inside rows for each interval
        by_span: dict[int, list] = {}
        for r in rows:
            by_span.setdefault(r["j"], []).append((r["x"], r["count"]))
        for v in by_span.values():
            v.sort()
        for t, (lo, hi, below) in small.items():
            at = below
            for x, n in by_span[spans.index((t[0], lo, hi))]:
                at += n
                if t[1] < at:
                    done[t] = x
                    break
    out = {}
    for key, p in plan.items():
        if p is None:
            out[key] = None
            continue
        i, k0, k1, h = p
        a, b = done[(i, k0)], done[(i, k1)]
        out[key] = a if k0 == h or a == b else (k1 - h) * a + (h - k0) * b
    return out
