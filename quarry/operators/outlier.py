"""Outlier operators (O1, O2): clip to fences computed from exact quantiles."""

from __future__ import annotations

from quarry.functions.columns import c as col, clip, is_numeric, replace_columns
from quarry.functions.stats import quantiles
from quarry.operators.base import Operator, register


def _clip_transform(df, state):
    return replace_columns(df, {c: clip(col(c), st["lower"], st["upper"]) for c, st in state.items()})


class CapOutliersIQR(Operator):
    """Clip to ``[Q1 - f*IQR, Q3 + f*IQR]``; skipped when IQR <= 0.

    ``reference_compat=True`` reproduces the upstream upper fence ``Q3 - f*IQR``.
    """

    name, family = "cap_outliers_iqr", "outlier"

    def fit(self, df, columns, factor: float = 1.5, reference_compat: bool = False,
            exact: bool = True, **params):
        num = [c for c in columns if is_numeric(df, c)]
        q = quantiles(df, num, [0.25, 0.75], exact=exact)
        state = {}
        for c in columns:
            if c not in df.columns:
                continue
            if c not in q:
                state[c] = {"skip": "not numeric"}
                continue
            q1, q3 = q[c]
            if q1 is None:
                state[c] = {"skip": "no values"}
                continue
            iqr = q3 - q1
            if iqr <= 0:
                state[c] = {"skip": "IQR is 0"}
                continue
            upper = q3 - factor * iqr if reference_compat else q3 + factor * iqr
            state[c] = {"lower": q1 - factor * iqr, "upper": upper, "q1": q1, "q3": q3}
        return state

    def transform(self, df, state):
        return _clip_transform(df, state)


class WinsorizeByQuantile(Operator):
    name, family = "winsorize_by_quantile", "outlier"

    def fit(self, df, columns, lower_q: float = 0.01, upper_q: float = 0.99, exact: bool = True, **params):
        num = [c for c in columns if is_numeric(df, c)]
        q = quantiles(df, num, [lower_q, upper_q], exact=exact)
        state = {}
        for c in columns:
            if c not in df.columns:
                continue
            if c not in q:
                state[c] = {"skip": "not numeric"}
            elif q[c][0] is None:
                state[c] = {"skip": "no values"}
            else:
                state[c] = {"lower": q[c][0], "upper": q[c][1]}
        return state

    def transform(self, df, state):
        return _clip_transform(df, state)


cap_outliers_iqr = register(CapOutliersIQR())
winsorize_by_quantile = register(WinsorizeByQuantile())
