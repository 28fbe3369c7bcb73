"""Column statistics as distributed Spark jobs.

* ``moments`` — one grouped aggregate over the unpivoted columns (partial
  aggregation per task, a single tiny shuffle).
* ``exact_quantiles`` — exact order statistics by selection. A sketch with a bounded rank
  error brackets every wanted rank; the next pass counts the values below each bracket and
  groups only those inside. A bracket that would still hold too many is narrowed by
  another sketch of its inside first. What is shuffled is a few thousandths of the
  rows (each value once a task), whatever the number of distinct values.
* ``approx_quantiles`` — ``percentile_approx`` for very large tables when the
  caller accepts rank error.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOMENT_STATS = ("count", "nulls", "mean", "std", "std_pop", "min", "max", "skew", "kurt")


def moments(df: DataFrame, cols: list[str], stats: list[str] = MOMENT_STATS) -> dict[str, dict[str, object]]:
    """Count, nulls, mean, sample/population std, min, max and the bias-corrected
    skewness/kurtosis of every column in ONE job: the columns are unpivoted to
    (k, v) and grouped by k, so each task partially aggregates C groups and a
    single tiny shuffle combines them. (One wide aggregate with a set of
    central-moment buffers per column is several times slower to execute.)
    Returns {col: {stat: value}}.
    """
    if not cols:
        return {}
    casted = df.select(*[F.col(quote_name(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    long = casted.unpivot([], [f"c{i}" for i in range(len(cols))], "k", "v")
    v = F.col("v")
    n = F.count(v).cast("double")
    aggs = [F.count(v).alias("count"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"), F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
            F.when(n > 3, ((n + 1) * F.kurtosis(v) + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurt")]
    wanted = [a for a, name in zip(aggs, MOMENT_STATS) if name in stats]
    rows = long.groupBy("k").agg(*wanted).collect()
    by_k = {r["k"]: r.asDict() for r in rows}
    out = {}
    for i, c in enumerate(cols):
        r = by_k.get(f"c{i}", {})
        out[c] = {s_: r.get(s_) for s_ in stats}
    return out


def quote_name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(k, v) pairs of the non-null values of ``cols`` (cast to double)."""
    casted = df.select(*[F.col(quote_name(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"c{i}"), F.lit(c))])
    long = casted.unpivot([], [f"c{i}" for i in range(len(cols))], "k", "v").filter(F.col("v").isNotNull())
    return long.select(names[F.col("k")].alias("k"), "v")


def rank_positions(n: int, p: float) -> tuple[int, int, float]:
    """0-based neighbouring ranks and weight for linear interpolation (type 7)."""
    h = p * (n - 1)
    lo = math.floor(h)
    hi = min(lo + 1, n - 1) if h > lo else lo
    return lo, hi, h - lo


#: Steps of the sketch's grid of ranks, and the sketch's accuracy (its ranks are off by at most a fifth of a step).
GRID, ACCURACY = 2000, 10_000
#: Values that a bracket may hold, about, before they are grouped.
BRACKET_VALUES = 200_000
_BRACKET = "k string, j int, lo double, hi double"


def _grids(inside: DataFrame) -> dict[tuple[str, int], tuple[int, list[float]]]:
    """For each (k, j): the number of values and their approximate quantiles at the grid's steps."""
    steps = [i / GRID for i in range(GRID + 1)]
    rows = inside.groupBy("k", "j").agg(F.count("v").alias("n"), F.percentile_approx("v", steps, ACCURACY).alias("q")).collect()
    return {(r["k"], r["j"]): (int(r["n"]), r["q"]) for r in rows}


def _bracket(rank: tuple[int, int], n: int, grid: list[float]) -> tuple[float | None, float | None, float]:
    """Bounds (None: unbounded) that surely hold the values of two neighbouring ranks among n, and about how many they hold."""
    lo = math.floor((rank[0] - 1) / n * GRID) - 2
    hi = math.ceil((rank[1] + 2) / n * GRID) + 2
    return grid[lo] if lo > 0 else None, grid[hi] if hi < GRID else None, (min(hi, GRID) - max(lo, 0) + 1) / GRID * n


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    num_partitions: int | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles (pandas ``quantile`` / DuckDB
    ``quantile_cont`` / Spark ``percentile``) of each column."""
    if not cols:
        return {}
    spark = df.sparkSession
    long = _long_values(df, cols)
    first = _grids(long.withColumn("j", F.lit(0)))
    sizes = {k: n for (k, _), (n, _) in first.items()}
    ranks = {(k, j): rank_positions(n, p) for k, n in sizes.items() for j, p in enumerate(probs)}
    bounds = {(k, j): _bracket(r[:2], sizes[k], first[k, 0][1]) for (k, j), r in ranks.items()}

    def placed(wanted) -> DataFrame:
        """Values up to each bracket's upper bound, once a bracket; ``x`` is null below the lower bound."""
        table = spark.createDataFrame([(k, j, *bounds[k, j][:2]) for k, j in wanted], _BRACKET)  # a row a bracket
        return (long.join(F.broadcast(table), "k").where(F.col("hi").isNull() | (F.col("v") <= F.col("hi")))
                .withColumn("x", F.when(F.col("lo").isNull() | (F.col("v") >= F.col("lo")), F.col("v"))))

    while wide := [kj for kj, (lo, hi, held) in bounds.items() if held > BRACKET_VALUES and (lo is None or lo != hi)]:
        rows = placed(wide)
        below = {(r["k"], r["j"]): int(r["n"]) for r in rows.where("x is null").groupBy("k", "j").agg(F.count("v").alias("n")).collect()}
        changed = False
        for kj, (n, grid) in _grids(rows.where("x is not null").select("k", "j", F.col("x").alias("v"))).items():
            lo, hi, held = bounds[kj]
            at = below.get(kj, 0)
            new_lo, new_hi, new_held = _bracket((ranks[kj][0] - at, ranks[kj][1] - at), n, grid)
            new = (lo if new_lo is None else new_lo, hi if new_hi is None else new_hi, new_held)
            changed |= new[:2] != (lo, hi)
            bounds[kj] = new
        if not changed:  # few different values, in many rows each
            break

    values: dict[tuple[str, int], dict[int, float]] = {kj: {} for kj in ranks}
    open_ = []
    for kj, (lo, hi, _) in bounds.items():
        if lo is not None and lo == hi:
            values[kj] = dict.fromkeys(ranks[kj][:2], lo)
        else:
            open_.append(kj)
    if open_:
        grouped = placed(open_).groupBy("k", "j", "x").agg(F.count("v").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            below = {(r["k"], r["j"]): int(r["n"]) for r in grouped.where("x is null").collect()}
            local = [(k, j, r - below.get((k, j), 0), r) for k, j in open_ for r in sorted(set(ranks[k, j][:2]))]
            targets = F.broadcast(spark.createDataFrame(local, "k string, j int, at long, rank long"))
            w = Window.partitionBy("k", "j").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
            upto = grouped.where("x is not null").withColumn("upto", F.sum("n").over(w))
            hits = upto.join(targets, ["k", "j"]).where("at < upto and at >= upto - n").select("k", "j", "rank", "x").collect()
        finally:
            grouped.unpersist()
        for r in hits:
            values[r["k"], r["j"]][r["rank"]] = r["x"]
    out: dict[str, list[float | None]] = {k: [None] * len(probs) for k in cols}
    for (k, j), (lo, hi, weight) in ranks.items():
        a, b = values[k, j][lo], values[k, j][hi]
        out[k][j] = a + (b - a) * weight if weight else a
    return out


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     accuracy: int = 100000) -> dict[str, list[float | None]]:
    """Approximate quantiles for all columns in one aggregate (Greenwald-Khanna)."""
    if not cols:
        return {}
    exprs = [F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(f"q{i}")
             for i, c in enumerate(cols)]
    row = df.agg(*exprs).collect()[0]
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True):
    return exact_quantiles(df, cols, probs) if exact else approx_quantiles(df, cols, probs)
