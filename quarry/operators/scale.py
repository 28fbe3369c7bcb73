"""Scaling and power transforms (C1-C4), with the scikit-learn conventions:
population std, zero spread divides by 1, robust scaling centres on the median."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import c as col, is_numeric, replace_columns
from quarry.functions.stats import moments, quantiles
from quarry.operators.base import Operator, register


def _numeric_state(df, columns, fn):
    state = {}
    for c in columns:
        if c not in df.columns:
            continue
        state[c] = fn(c) if is_numeric(df, c) else {"skip": "not numeric"}
    return state


def _affine(df, state):
    new = {c: (col(c).cast("double") - F.lit(st["center"])) / F.lit(st["scale"]) for c, st in state.items()}
    return replace_columns(df, new)


def _nz(x):
    return 1.0 if x is None or x == 0 else float(x)


class StandardScale(Operator):
    name, family = "standard_scale_column", "scale"

    def fit(self, df, columns, **params):
        m = moments(df, [c for c in columns if is_numeric(df, c)], ["mean", "std_pop"])
        return _numeric_state(df, columns, lambda c: (
            {"skip": "no values"} if m[c]["mean"] is None else
            {"center": float(m[c]["mean"]), "scale": _nz(m[c]["std_pop"])}))

    def transform(self, df, state):
        return _affine(df, state)


class MinMaxScale(Operator):
    name, family = "min_max_scale_column", "scale"

    def fit(self, df, columns, **params):
        m = moments(df, [c for c in columns if is_numeric(df, c)], ["min", "max"])
        return _numeric_state(df, columns, lambda c: (
            {"skip": "no values"} if m[c]["min"] is None else
            {"center": float(m[c]["min"]), "scale": _nz(float(m[c]["max"]) - float(m[c]["min"]))}))

    def transform(self, df, state):
        return _affine(df, state)


class RobustScale(Operator):
    name, family = "robust_scale_column", "scale"

    def fit(self, df, columns, exact: bool = True, **params):
        q = quantiles(df, [c for c in columns if is_numeric(df, c)], [0.25, 0.5, 0.75], exact=exact)
        return _numeric_state(df, columns, lambda c: (
            {"skip": "no values"} if q[c][1] is None else
            {"center": q[c][1], "scale": _nz(q[c][2] - q[c][0])}))

    def transform(self, df, state):
        return _affine(df, state)


# ---- Yeo-Johnson ---------------------------------------------------------

def yeo_johnson(x: Column, lam: float) -> Column:
    """Closed-form Yeo-Johnson transform for a fixed lambda (NULL stays NULL)."""
    x = x.cast("double")
    if abs(lam) < 1e-12:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    if abs(lam - 2) < 1e-12:
        neg = -F.log1p(-x)
    else:
        neg = -(F.pow(-x + 1, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, pos).when(x < 0, neg)


#: Lambdas tried in one pass, of each column.
TRIED = 9
#: Lambdas beyond this are not tried: powers overflow there.
FARTHEST = 64.0


def _tried(first: int, last: int) -> list[int]:
    """At most TRIED grid places from ``first`` to ``last``, both included, evenly spread."""
    n = min(TRIED, last - first + 1)
    return sorted({first + (last - first) * i // max(n - 1, 1) for i in range(n)})


def fit_yeo_johnson_lambdas(df: DataFrame, columns: list[str], lo: float = -2.0, hi: float = 2.0,
                            step: float = 0.1, refinements: int = 2) -> dict[str, float | None]:
    """Maximum-likelihood lambda of every column, on the grid of ``step`` / 10 ** ``refinements``:
    llf(lam) = -n/2 * log(var_pop(yj(x, lam))) + (lam - 1) * sum(sign(x) * log1p(|x|)).

    A bracketed search of all columns together: each pass is one aggregate without a
    shuffle of rows, holding the variances at a few lambdas of every column's bracket; the
    best one's neighbours are the next bracket. While the best lies on the edge of [lo, hi],
    the bracket moves outwards. The number of passes depends on the width of the grid,
    not on the number of columns. A column without values or spread has None.
    """
    if not columns:
        return {}
    fine = step / 10 ** refinements
    place = lambda v: int(round(v / fine))
    lam = lambda i: round(i * fine, 10)
    span = place(hi) - place(lo)
    bracket = {c: (place(lo), place(hi)) for c in columns}
    moving = dict.fromkeys(columns, span > 0)
    seen: dict[str, dict[int, float]] = {c: {} for c in columns}
    size: dict[str, tuple[int, float]] = {}
    base = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).persist()
    found: dict[str, float | None] = {}
    try:
        while len(found) < len(columns):
            asked = {(c, g): f"v{i}_{k}" for i, c in enumerate(columns) if c not in found
                     for k, g in enumerate(_tried(*bracket[c])) if g not in seen[c]}
            x = {c: F.col(f"x{i}") for i, c in enumerate(columns)}
            stats = [] if size else [e for i, c in enumerate(columns) for e in (
                F.count(x[c]).alias(f"n{i}"), F.sum(F.signum(x[c]) * F.log1p(F.abs(x[c]))).alias(f"s{i}"))]
            wanted = [*stats, *[F.var_pop(yeo_johnson(x[c], lam(g))).alias(name) for (c, g), name in asked.items()]]
            row = base.agg(*wanted).first() if wanted else {}
            size = size or {c: (row[f"n{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
            for (c, g), name in asked.items():
                n, total = size[c]
                v = row[name]
                usable = n and v is not None and v > 0 and np.isfinite(v)
                seen[c][g] = -n / 2.0 * math.log(v) + (lam(g) - 1) * total if usable else -math.inf
            for c in columns:
                if c in found:
                    continue
                first, last = bracket[c]
                here = _tried(first, last)
                best = here[0]
                for g in here[1:]:
                    if seen[c][g] > seen[c][best] + 1e-12:
                        best = g
                if seen[c][best] == -math.inf:
                    found[c] = None
                elif moving[c] and best in (first, last) and abs(lam(best)) < FARTHEST:
                    # the optimum may lie further out
                    bracket[c] = (best - span, best + 1) if best == first else (best - 1, best + span)
                elif here == list(range(first, last + 1)):
                    found[c] = lam(best)
                else:
                    i = here.index(best)
                    moving[c] = False
                    bracket[c] = (here[max(i - 1, 0)], here[min(i + 1, len(here) - 1)])
    finally:
        base.unpersist()
    return found


def fit_yeo_johnson_lambda(df: DataFrame, c: str, lo: float = -2.0, hi: float = 2.0,
                           step: float = 0.1, refinements: int = 2) -> float | None:
    """``fit_yeo_johnson_lambdas`` of one column."""
    return fit_yeo_johnson_lambdas(df, [c], lo, hi, step, refinements)[c]


class YeoJohnson(Operator):
    name, family = "yeo_johnson_transform_column", "transform"

    def fit(self, df, columns, refinements: int = 2, **params):
        lams = fit_yeo_johnson_lambdas(df, [c for c in columns if c in df.columns and is_numeric(df, c)], refinements=refinements)
        return _numeric_state(df, columns, lambda c: {"skip": "fit failed"} if lams[c] is None else {"lambda": lams[c]})

    def transform(self, df, state):
        return replace_columns(df, {c: yeo_johnson(col(c), st["lambda"]) for c, st in state.items()})


standard_scale_column = register(StandardScale())
min_max_scale_column = register(MinMaxScale())
robust_scale_column = register(RobustScale())
yeo_johnson_transform_column = register(YeoJohnson())
