"""Splits and folds (D1-D5) over a global row index.

All of them are predicates on a 1-based index column, so a split or a fold is
a filter on the (checkpointed) indexed table: no rows are copied per fold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import c as col
from quarry.functions.ranking import global_index


def add_time_index(df: DataFrame, time_col: str, key_cols: list[str], index_col: str = "idx") -> DataFrame:
    """Index in (time, key) order."""
    return global_index(df, [time_col, *key_cols], index_col)


def sequential_cut(n: int, test_size: float = 0.2) -> int:
    """Number of training rows of a sequential split: ``int(n * (1 - test_size))``."""
    return int(n * (1 - test_size))


def split_sequential(indexed: DataFrame, n: int, test_size: float = 0.2, index_col: str = "idx",
                     split_col: str = "split") -> DataFrame:
    """The first ``int(n(1-test_size))`` rows train, the rest test."""
    cut = sequential_cut(n, test_size)
    return indexed.withColumn(split_col, F.when(F.col(index_col) <= cut, F.lit("train")).otherwise(F.lit("test")))


def hash_order(key_cols: list[str], seed: int = 42) -> Column:
    """A seeded pseudo-random permutation key: md5 of the seed and the keys as text (keys that
    together tell rows apart), which other engines compute alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key_cols]))


def hash_bounds(df: DataFrame, key_cols: list[str], counts: list[int], seed: int = 42) -> list[str]:
    """The hashes of the rows at the given (1-based, ascending) places of the permutation.

    Only hashes are sorted: the rows are counted by the first digits of their hash (65,536
    small counts), which says in which slot each place lies; the few rows of those slots are
    ranked within their slot.
    """
    h = df.select(hash_order(key_cols, seed).alias("h"))
    slots = sorted((r["s"], int(r["n"])) for r in h.groupBy(F.substring("h", 1, 4).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    wanted, before = [], 0
    places = list(counts)
    for slot, n in slots:
        while places and places[0] <= before + n:
            wanted.append((slot, places.pop(0) - before))
        before += n
    ranked = (h.withColumn("s", F.substring("h", 1, 4)).filter(F.col("s").isin(*{s for s, _ in wanted}))
              .withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("h"))))  # a 65,536th of the rows each
    hit = F.lit(False)
    for s, r in wanted:
        hit = hit | ((F.col("s") == s) & (F.col("r") == r))
    found = {(r["s"], r["r"]): r["h"] for r in ranked.filter(hit).collect()}
    return [found[w] for w in wanted]


def split_random(df: DataFrame, key_cols: list[str], n: int, test_size: float = 0.2, seed: int = 42,
                 split_col: str = "split") -> DataFrame:
    """D3: exactly ``ceil(n * test_size)`` test rows, the first of a seeded permutation (a filter on each row's own hash)."""
    n_test = int(math.ceil(n * test_size))
    bound = hash_bounds(df, key_cols, [n_test], seed)[0] if n_test else ""
    return df.withColumn(split_col, F.when(hash_order(key_cols, seed) <= bound, F.lit("test")).otherwise(F.lit("train")))


def time_series_folds(n: int, k: int = 5) -> list[dict]:
    """Expanding-window folds (1-based, inclusive bounds)."""
    b = n // (k + 1)
    out = []
    for i in range(1, k + 1):
        start = n - (k - i + 1) * b
        out.append({"fold": i, "train_lo": 1, "train_hi": start, "val_lo": start + 1, "val_hi": start + b})
    return out


def tag_folds(indexed: DataFrame, folds: list[dict], index_col: str = "idx") -> DataFrame:
    """Each row once for each fold it belongs to, with ``fold`` and ``role`` (train or val), in one pass."""
    x = F.col(index_col)
    tags = F.array_compact(F.array(*[
        F.when(x.between(f["train_lo"], f["train_hi"]), F.struct(F.lit(f["fold"]).alias("fold"), F.lit("train").alias("role")))
         .when(x.between(f["val_lo"], f["val_hi"]), F.struct(F.lit(f["fold"]).alias("fold"), F.lit("val").alias("role"))) for f in folds]))
    return indexed.select("*", F.inline(tags))


def fold_filter(fold: dict, role: str, index_col: str = "idx") -> Column:
    x = F.col(index_col)
    if role == "train":
        return x.between(fold["train_lo"], fold["train_hi"]) if "train_lo" in fold else x.isNotNull()
    return x.between(fold["val_lo"], fold["val_hi"])


def kfold_sizes(n: int, k: int) -> list[int]:
    """Fold sizes of a shuffled k-fold: the first ``n % k`` folds get one extra row."""
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def random_folds(df: DataFrame, key_cols: list[str], n: int, k: int = 5, seed: int = 42,
                 fold_col: str = "fold") -> DataFrame:
    """Contiguous blocks of a seeded permutation, sized like a shuffled k-fold (``n`` >= ``k``)."""
    bounds, acc = [], 0
    for s in kfold_sizes(n, k):
        acc += s
        bounds.append(acc)
    cuts = hash_bounds(df, key_cols, [b for b in bounds[:-1] if b], seed)
    h, fold = hash_order(key_cols, seed), F.lit(k)
    for i in range(len(cuts), 0, -1):
        fold = F.when(h <= cuts[i - 1], F.lit(i + k - 1 - len(cuts))).otherwise(fold)
    return df.withColumn(fold_col, fold)
