"""Missing-value operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import c as col, is_numeric, replace_columns
from quarry.functions.stats import exact_quantiles, moments
from quarry.operators.base import Operator, register


def _null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    if not cols:
        return {}
    row = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: int(row[f"n{i}"]) for i, c in enumerate(cols)}


def mode_values(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value of each column, the smallest on ties, as text.

    One grouped count over (column, value) pairs for all columns (map-side combined, so a
    hot value costs one row per task), then the best pair of each column.
    """
    if not columns:
        return {}
    names = [f"c{i}" for i in range(len(columns))]
    long = df.select(*[col(c).cast("string").alias(n) for c, n in zip(columns, names)]).unpivot([], names, "k", "v")
    counts = long.filter(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    numeric = [n for c, n in zip(columns, names) if is_numeric(df, c)]
    size = F.when(F.col("k").isin(*numeric), F.col("v").try_cast("double")) if numeric else F.lit(None).cast("double")
    best = counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("n"), size, "v")).alias("v"))
    found = {r["k"]: r["v"] for r in best.collect()}  # a row for each column
    return {c: found.get(n) for c, n in zip(columns, names)}


def _fill(df: DataFrame, state: dict) -> DataFrame:
    new = {}
    for c, st in state.items():
        target_type = st.get("cast")
        fill = F.lit(st["value"]).cast(target_type) if target_type else F.lit(st["value"])
        expr = F.coalesce(col(c), fill)
        new[c] = expr.cast(target_type) if target_type else expr
    return replace_columns(df, new)


class ImputeMean(Operator):
    name, family = "impute_mean", "fill"

    def fit(self, df, columns, **params):
        state = {}
        num = [c for c in columns if is_numeric(df, c)]
        m = moments(df, num, ["nulls", "mean"])
        for c in columns:
            if c not in df.columns:
                continue
            if c not in m:
                state[c] = {"skip": "not numeric"}
            elif m[c]["nulls"] == 0:
                state[c] = {"skip": "no missing values"}
            elif m[c]["mean"] is None:
                state[c] = {"skip": "all values missing"}
            else:
                state[c] = {"value": float(m[c]["mean"]), "cast": "double"}
        return state

    def transform(self, df, state):
        return _fill(df, state)


class ImputeMedian(Operator):
    name, family = "impute_median", "fill"

    def fit(self, df, columns, exact: bool = True, **params):
        state = {}
        num = [c for c in columns if is_numeric(df, c)]
        nulls = _null_counts(df, num)
        todo = [c for c in num if nulls[c] > 0]
        q = exact_quantiles(df, todo, [0.5])
        for c in columns:
            if c not in df.columns:
                continue
            if c not in nulls:
                state[c] = {"skip": "not numeric"}
            elif nulls[c] == 0:
                state[c] = {"skip": "no missing values"}
            elif q[c][0] is None:
                state[c] = {"skip": "all values missing"}
            else:
                state[c] = {"value": float(q[c][0]), "cast": "double"}
        return state

    def transform(self, df, state):
        return _fill(df, state)


class ImputeMostFrequent(Operator):
    name, family = "impute_most_frequent", "fill"

    def fit(self, df, columns, **params):
        present = [c for c in columns if c in df.columns]
        nulls = _null_counts(df, present)
        modes = mode_values(df, [c for c in present if nulls[c]])
        state = {}
        for c in present:
            if nulls[c] == 0:
                state[c] = {"skip": "no missing values"}
            elif modes[c] is None:
                state[c] = {"skip": "all values missing"}
            else:
                state[c] = {"value": modes[c], "cast": df.schema[c].dataType.simpleString()}
        return state

    def transform(self, df, state):
        return _fill(df, state)


class ImputeAuto(Operator):
    """Numeric: median when |adjusted skew| >= threshold, else mean; other types: mode."""

    name, family = "impute_auto", "fill"

    def fit(self, df, columns, skew_threshold: float = 1.0, **params):
        present = [c for c in columns if c in df.columns]
        num = [c for c in present if is_numeric(df, c)]
        m = moments(df, num, ["nulls", "mean", "skew"])
        other_nulls = _null_counts(df, [c for c in present if c not in m])
        modes = mode_values(df, [c for c, k in other_nulls.items() if k])
        state = {}
        medians_needed = [c for c in num if m[c]["nulls"] > 0 and m[c]["skew"] is not None
                          and abs(m[c]["skew"]) >= skew_threshold]
        med = exact_quantiles(df, medians_needed, [0.5])
        for c in present:
            if c in m:
                if m[c]["nulls"] == 0:
                    state[c] = {"skip": "no missing values"}
                elif m[c]["mean"] is None:
                    state[c] = {"skip": "all values missing"}
                elif c in med:
                    state[c] = {"value": float(med[c][0]), "cast": "double", "strategy": "median",
                                "skew": m[c]["skew"]}
                else:
                    state[c] = {"value": float(m[c]["mean"]), "cast": "double", "strategy": "mean",
                                "skew": m[c]["skew"]}
            else:
                if other_nulls[c] == 0:
                    state[c] = {"skip": "no missing values"}
                    continue
                v = modes[c]
                state[c] = ({"skip": "all values missing"} if v is None else
                            {"value": v, "cast": df.schema[c].dataType.simpleString(), "strategy": "mode"})
        return state

    def transform(self, df, state):
        return _fill(df, state)


class AddMissingIndicator(Operator):
    name, family = "add_missing_indicator", "indicator"

    def fit(self, df, columns, suffix: str = "_ismissing", **params):
        return {c: {"suffix": suffix} for c in columns if c in df.columns}

    def transform(self, df, state):
        new = {f"{c}{st['suffix']}": col(c).isNull().cast("int") for c, st in state.items()}
        return replace_columns(df, new)


class ImputeConstant(Operator):
    """Fill with a fixed value (the knowledge rule ``fill_with_zero`` uses 0)."""

    name, family = "impute_constant", "fill"

    def fit(self, df, columns, value=0, **params):
        return {c: {"value": value} for c in columns if c in df.columns}

    def transform(self, df, state):
        new = {c: F.coalesce(col(c), F.lit(st["value"]).cast(df.schema[c].dataType)) for c, st in state.items()}
        return replace_columns(df, new)


impute_mean = register(ImputeMean())
impute_median = register(ImputeMedian())
impute_most_frequent = register(ImputeMostFrequent())
impute_auto = register(ImputeAuto())
add_missing_indicator = register(AddMissingIndicator())
impute_constant = register(ImputeConstant())
