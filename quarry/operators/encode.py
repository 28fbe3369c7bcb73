"""Categorical encoders.

Per-category statistics are grouped counts/means (map-side combined, so a
category holding a third of the rows costs one row per task before the
shuffle). They return to the rows through ``lookup_join``: broadcast when the
category table is proven small, otherwise a shuffle join whose hot keys AQE
splits. All columns of a step are fitted by one group-by over (column, value) pairs,
so the number of jobs does not grow with the columns.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import c as col, quote, replace_columns
from quarry.functions.joins import lookup_join
from quarry.functions.ranking import global_index
from quarry.operators.base import Operator, register
from quarry.session import materialize

# More values than this make one sparse vector column instead of a column each.
MAX_ONE_HOT_COLUMNS = 1000
# Dictionaries up to this size are numbered by a per-column window.
LABEL_WINDOW_MAX_DISTINCT = 100_000
NULL_LABEL = "__NULL__"
RARE_LABEL = "__RARE__"


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(_k, _v): column name and value as text, for every row and column."""
    text = [col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("_k", 2, 9).cast("int") + 1)
    return df.select(*text).unpivot([], [f"c{i}" for i in range(len(columns))], "_k", "_v").select(names.alias("_k"), "_v")


def _distinct_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    return _pairs(df, columns).distinct()


def _value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(_k, _v, _n): how often each value of each column occurs, all columns in one group-by,
    checkpointed as everything fitted from it reads it again."""
    return materialize(_pairs(df, columns).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n")))


def _sizes(pairs: DataFrame) -> dict[str, int]:
    return {r["_k"]: int(r["n"]) for r in pairs.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column


def _typed(df: DataFrame, c: str, texts: list) -> list:
    """The texts as values of the column's own type (a bounded list)."""
    if isinstance(df.schema[c].dataType, T.StringType):
        return list(texts)
    rows = df.sparkSession.createDataFrame([(t,) for t in texts], "v string")
    return [r[0] for r in rows.select(F.col("v").cast(df.schema[c].dataType)).collect()]


class OneHot(Operator):
    """Integer indicator per sorted value, ``{col}_{value}``; source dropped; NULL -> ``{col}_nan``.

    A column of more than ``max_columns`` values becomes one sparse vector ``{col}_onehot``
    instead, with a place for each value in sorted order and a last one for NULL and
    values that were not seen: nothing is cut, and the schema stays readable. Its
    values stay in a table; they never reach the driver.
    """

    name, family = "one_hot_encode_column", "encode"

    def fit(self, df, columns, max_columns: int = MAX_ONE_HOT_COLUMNS, **params):
        present = [c for c in columns if c in df.columns]
        if not present:
            return {}
        pairs = materialize(_distinct_pairs(df, present).withColumn("_n", F.lit(1)))
        sizes = _sizes(pairs)
        small = [c for c in present if sizes.get(c, 0) <= max_columns]
        values: dict[str, list] = {c: [] for c in small}
        for r in pairs.filter(F.col("_k").isin(*small)).collect() if small else []:  # at most max_columns each
            values[r["_k"]].append(r["_v"])
        state = {}
        for c in present:
            kind = df.schema[c].dataType
            if c in values:
                state[c] = {"values": sorted((v for v in _typed(df, c, values[c]) if v is not None)),
                            "has_null": any(v is None for v in values[c])}
            else:
                mine = pairs.filter((F.col("_k") == c) & F.col("_v").isNotNull()).select(F.col("_v").cast(kind).alias("_v"))
                codes = global_index(mine, ["_v"], "_code").select("_v", (F.col("_code") - 1).cast("double").alias("_code"))
                state[c] = {"codes": codes, "n_codes": codes.count()}
        return state

    def transform(self, df, state):
        keep = [F.col(quote(x)) for x in df.columns if x not in state or "codes" in state[x]]
        new = []
        for c, st in state.items():
            if "codes" in st:
                continue
            for v in st["values"]:
                new.append(col(c).eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{v}"))
            if st["has_null"]:
                new.append(col(c).isNull().cast("int").alias(f"{c}_nan"))
        out = df.select(*keep, *new)
        for c, st in state.items():
            if "codes" in st:
                codes = st["codes"]
                n = float(st["n_codes"])
                out = lookup_join(out, codes, col(c) == codes["_v"], "left").drop("_v")
                out = out.withColumn("_code", F.coalesce("_code", F.lit(n)))
                hot = OneHotEncoder(inputCols=["_code"], outputCols=[f"{c}_onehot"], dropLast=False)
                top = df.sparkSession.range(1).select(F.lit(n).alias("_code"))  # fixes the vector's length
                out = hot.fit(top).transform(out).drop("_code", c)
        return out


class LabelEncode(Operator):
    """0..k-1 in sorted order; NULL becomes the ordinary label ``__NULL__``.

    All text columns are fitted together: one aggregate finds the columns with
    NULLs, one distinct over the unpivoted (column, value) pairs gives every
    dictionary, and columns with at most ``LABEL_WINDOW_MAX_DISTINCT`` values
    are numbered by a dense rank per column (one bounded sort per column). A
    column with more values is numbered by the global index instead, so no
    single task ever sorts an unbounded dictionary.
    """

    name, family = "label_encode_column", "encode"

    def fit(self, df, columns, **params):
        present = [c for c in columns if c in df.columns]
        if not present:
            return {}
        nulls = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(present)]).collect()[0]
        has_null = {c: nulls[f"n{i}"] > 0 for i, c in enumerate(present)}
        text = [c for c in present if has_null[c] or isinstance(df.schema[c].dataType, T.StringType)]
        state = {}
        if text:
            keyed = df.select(*[F.coalesce(col(c).cast("string"), F.lit(NULL_LABEL)).alias(f"c{i}")
                                for i, c in enumerate(text)])
            pairs = keyed.unpivot([], [f"c{i}" for i in range(len(text))], "_k", "_v").distinct()
            pairs = materialize(pairs)
            sizes = _sizes(pairs)
            small = [k for k, n in sizes.items() if n <= LABEL_WINDOW_MAX_DISTINCT]
            w = Window.partitionBy("_k").orderBy("_v")
            ranked = materialize(pairs.filter(F.col("_k").isin(*small))
                                 .withColumn("_code", (F.dense_rank().over(w) - 1).cast("int"))) \
                if small else None
            for i, c in enumerate(text):
                k = f"c{i}"
                if k in small:
                    codes = ranked.filter(F.col("_k") == k).select("_v", "_code")
                else:
                    codes = global_index(pairs.filter(F.col("_k") == k).select("_v"), ["_v"], "_code")
                    codes = materialize(codes.select("_v", (F.col("_code") - 1).cast("int").alias("_code")))
                state[c] = {"as_string": True, "codes": codes, "n_codes": sizes.get(k, 0)}
        for c in present:
            if c in state:
                continue
            # a non-text column without NULLs keeps its own (numeric / temporal) order
            distinct = df.select(col(c).alias("_v")).distinct()
            codes = global_index(distinct, ["_v"], "_code")
            codes = materialize(codes.select("_v", (F.col("_code") - 1).cast("int").alias("_code")))
            state[c] = {"as_string": False, "codes": codes, "n_codes": codes.count()}
        return state

    def transform(self, df, state):
        out = df
        for c, st in state.items():
            key = F.coalesce(col(c).cast("string"), F.lit(NULL_LABEL)) if st["as_string"] else col(c)
            codes = st["codes"]
            out = lookup_join(out.withColumn("_k", key), codes, F.col("_k") == codes["_v"], "left")
            # a value that was not seen gets the first code after the known ones
            code = F.coalesce(F.col("_code"), F.lit(int(st["n_codes"])))
            out = replace_columns(out.drop("_k", "_v"), {c: code}).drop("_code")
        return out


class TargetEncode(Operator):
    """Category mean shrunk to the prior: w = 1/(1+exp(-(n - min_samples_leaf)/smoothing)),
    enc = prior*(1-w) + mean*w; single-row categories and unseen values get the prior."""

    name, family = "target_encode_column", "encode"
    needs_target = True

    def fit(self, df, columns, target: str | None = None, smoothing: float = 5.0,
            min_samples_leaf: int = 20, **params):
        if target is None or target not in df.columns:
            return {c: {"skip": "target absent"} for c in columns if c in df.columns}
        mine = [c for c in columns if c in df.columns and c != target]
        if not mine:
            return {}
        prior = df.agg(F.avg(col(target))).collect()[0][0]
        text = [col(c).cast("string").alias(f"c{i}") for i, c in enumerate(mine)]
        long = df.select(col(target).alias("_y"), *text).unpivot("_y", [f"c{i}" for i in range(len(mine))], "_k", "_v")
        stats = long.groupBy("_k", "_v").agg(F.count("_y").alias("_n"), F.avg("_y").alias("_m"))
        w = 1.0 / (1.0 + F.exp(-(F.col("_n") - F.lit(min_samples_leaf)) / F.lit(float(smoothing))))
        enc = F.when(F.col("_n") == 1, F.lit(prior)).otherwise(F.lit(prior) * (1 - w) + F.col("_m") * w)
        table = materialize(stats.select("_k", "_v", enc.alias("_enc")))  # all columns in one pass
        return {c: {"prior": prior, "map": table.filter(F.col("_k") == f"c{i}").select("_v", "_enc")} for i, c in enumerate(mine)}

    def transform(self, df, state):
        out = df
        for c, st in state.items():
            m = st["map"]
            out = lookup_join(out, m, col(c).cast("string").eqNullSafe(m["_v"]), "left")
            out = replace_columns(out.drop("_v"), {c: F.coalesce(F.col("_enc"), F.lit(st["prior"]))}).drop("_enc")
        return out


class FrequencyEncode(Operator):
    """Share of rows per value; NULL is a value with its own share."""

    name, family = "frequency_encode_column", "encode"

    def fit(self, df, columns, **params):
        present = [c for c in columns if c in df.columns]
        if not present:
            return {}
        counts = _value_counts(df, present)
        # every column's counts add up to the number of rows
        total = counts.filter(F.col("_k") == present[0]).agg(F.sum("_n")).collect()[0][0]
        share = F.col("_n") / F.lit(float(total or 1))
        return {c: {"map": counts.filter(F.col("_k") == c).select("_v", share.alias("_f"))} for c in present}

    def transform(self, df, state):
        out = df
        for c, st in state.items():
            m = st["map"]
            out = lookup_join(out, m, col(c).cast("string").eqNullSafe(m["_v"]), "left")
            out = replace_columns(out.drop("_v"), {c: F.col("_f")}).drop("_f")
        return out


class RareLabelCollapse(Operator):
    """Values whose row share is below ``min_freq`` (NULL included) become ``__RARE__``.

    The state is the table of frequent values, joined back like every other map; values
    that were not seen are rare. ``min_freq`` of 0 or less changes nothing.
    """

    name, family = "rare_label_collapse", "encode"

    def fit(self, df, columns, min_freq: float = 0.01, rare_label: str = RARE_LABEL, **params):
        present = [c for c in columns if c in df.columns]
        if not present or min_freq <= 0:
            return {c: {"skip": "no rare values"} for c in present}
        counts = _value_counts(df, present)
        total = counts.filter(F.col("_k") == present[0]).agg(F.sum("_n")).collect()[0][0]
        frequent = F.col("_n") / F.lit(float(total or 1)) >= F.lit(min_freq)
        rare = {r["_k"]: int(r["n"]) for r in counts.groupBy("_k").agg(F.count_if(~frequent).alias("n")).collect()}  # a row a column
        return {c: ({"skip": "no rare values"} if not rare.get(c) else
                    {"keep": counts.filter((F.col("_k") == c) & frequent).select("_v", F.lit(True).alias("_kept")),
                     "label": rare_label}) for c in present}

    def transform(self, df, state):
        out = df
        for c, st in state.items():
            m = st["keep"]
            x = col(c).cast("string")
            out = lookup_join(out, m, x.eqNullSafe(m["_v"]), "left").drop("_v")
            out = replace_columns(out, {c: F.when(F.col("_kept"), x).otherwise(F.lit(st["label"]))}).drop("_kept")
        return out


one_hot_encode_column = register(OneHot())
label_encode_column = register(LabelEncode())
target_encode_column = register(TargetEncode())
frequency_encode_column = register(FrequencyEncode())
rare_label_collapse = register(RareLabelCollapse())
