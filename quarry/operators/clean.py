"""Row and column cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import c as col, quote, replace_columns, safe_div
from quarry.operators.base import Operator, register

# The textual placeholders treated as missing.
# Reference semantics: unanchored, case-sensitive regex *search* for each of
#   ^\s*$   null   \(null\)   nan
# Default (ruling Q2): the whole trimmed cell must equal one of them, any case.
PLACEHOLDER_SEARCH_PATTERN = r"^\s*$|null|\(null\)|nan"
PLACEHOLDER_ANCHORED_PATTERN = r"(?i)^\s*(null|\(null\)|nan)?\s*$"


def target_cleaning(df: DataFrame, target: str) -> tuple[DataFrame, dict]:
    """drop rows whose target is NULL, then those where it is 0; count both.

    The counts come from one aggregate; the filter itself stays lazy.
    """
    t = col(target)
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(t.isNull()).alias("null_target"),
                 F.count_if(t == 0).alias("zero_target")).collect()[0]
    counts = row.asDict()
    counts["remaining"] = counts["rows"] - counts["null_target"] - counts["zero_target"]
    return target_filter(df, target), counts


def target_filter(df: DataFrame, target: str) -> DataFrame:
    t = col(target)
    return df.filter(t.isNotNull() & (t != 0))


def placeholder_to_null(x: Column, reference_compat: bool = False) -> Column:
    pattern = PLACEHOLDER_SEARCH_PATTERN if reference_compat else PLACEHOLDER_ANCHORED_PATTERN
    return F.when(x.rlike(pattern), F.lit(None).cast("string")).otherwise(x)


def normalize_placeholders(df: DataFrame, reference_compat: bool = False) -> DataFrame:
    """textual missing markers in every string column become NULL (one projection)."""
    new = {f.name: placeholder_to_null(col(f.name), reference_compat)
           for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return replace_columns(df, new)


def constant_columns(df: DataFrame, exempt: list[str] = (), exact: bool = True) -> list[dict]:
    """columns with at most one distinct non-null value (all-NULL included).

    ``min(c) <=> max(c)`` answers "at most one distinct value" for any orderable
    type in a single pass with O(1) state per column — the exact equivalent of
    ``nunique() <= 1`` without counting distinct values.
    """
    cols = [x for x in df.columns if x not in exempt]
    if not cols:
        return []
    exprs = []
    for i, x in enumerate(cols):
        exprs += [F.min(col(x)).alias(f"mn{i}"), F.max(col(x)).alias(f"mx{i}"), F.count(col(x)).alias(f"n{i}")]
    row = df.agg(*exprs).collect()[0]
    out = []
    for i, x in enumerate(cols):
        n = row[f"n{i}"]
        distinct = 0 if n == 0 else (1 if row[f"mn{i}"] == row[f"mx{i}"] else 2)
        out.append({"column": x, "non_null": int(n), "is_constant": distinct <= 1,
                    "reason": "empty" if n == 0 else ("constant" if distinct == 1 else "")})
    return out


def drop_constant_columns(df: DataFrame, exempt: list[str] = ()) -> tuple[DataFrame, list[str]]:
    drop = [r["column"] for r in constant_columns(df, exempt) if r["is_constant"]]
    return df.drop(*drop), drop


def screen_columns(df: DataFrame, target: str, other_targets: list[str], unsuitable: list[str],
                   keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """drop the other target metrics and the unsuitable fields, except the
    columns the user asked to keep; the target is never dropped; unknown names ignored."""
    keep_set = set(keep) | {target}
    drop = [x for x in df.columns if (x in set(other_targets) or x in set(unsuitable)) and x not in keep_set]
    return df.drop(*drop), drop


def row_missing_ratio(df: DataFrame, features: list[str]) -> Column:
    """Share of NULL cells across ``features`` for each row (a codegen'd sum)."""
    if not features:
        return F.lit(0.0)
    s = sum((col(x).isNull().cast("int") for x in features), F.lit(0))
    return safe_div(s, len(features))


def drop_rows_by_ratio(df: DataFrame, threshold: float, target: str | None = None, features: list[str] | None = None) -> DataFrame:
    """F8: keep rows whose missing share over the features (by default all but the target) is <= threshold."""
    feats = features or [x for x in df.columns if x != target]
    return df.filter(row_missing_ratio(df, feats) <= F.lit(threshold))


def time_sorted(df: DataFrame, time_col: str, tie_break: list[str]) -> DataFrame:
    """a total order on (time, tie-break key); a no-op if the time column is absent."""
    if time_col not in df.columns:
        return df
    return df.orderBy(*[col(x).asc_nulls_last() for x in [time_col, *tie_break]])


class DeleteColumn(Operator):
    name, family = "delete_column", "delete"

    def transform(self, df, state):
        return df.drop(*state.keys())


class DeleteRowsWithMissing(Operator):
    name, family = "delete_rows_with_missing_in_column", "delete"

    def transform(self, df, state):
        return df.na.drop(subset=list(state.keys()))


class NoAction(Operator):
    name, family = "no_action", "none"

    def transform(self, df, state):
        return df


delete_column = register(DeleteColumn())
delete_rows_with_missing_in_column = register(DeleteRowsWithMissing())
no_action = register(NoAction())


def select_features(df: DataFrame, exclude: list[str]) -> list[str]:
    return [x for x in df.columns if x not in set(exclude)]


__all__ = ["target_cleaning", "normalize_placeholders", "constant_columns", "screen_columns",
           "drop_rows_by_ratio", "row_missing_ratio", "time_sorted", "quote"]
