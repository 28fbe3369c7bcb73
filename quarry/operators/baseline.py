"""A group-mean predictor: the per-group mean of the target on the fit rows,
falling back to the overall mean for groups not seen when fitting.

It is deterministic, so its predictions (and every metric over them) can be
checked against SQL; the tree learners are in ``learners``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.joins import lookup_join
from quarry.session import materialize


def fit_group_mean(train: DataFrame, group: str, target: str) -> tuple[DataFrame, float, int]:
    """Per-group means (a small checkpointed table), the overall mean and the number of groups.

    The overall mean is derived from the group table (sum n*m / sum n), so fitting
    costs one pass over the rows.
    """
    stats = (train.filter(F.col(target).isNotNull()).groupBy(group)
                  .agg(F.avg(target).alias("_gm"), F.count(target).alias("_n")))
    stats = materialize(stats)
    r = stats.agg(F.count(F.lit(1)).alias("k"), (F.sum(F.col("_gm") * F.col("_n")) / F.sum("_n")).alias("o")).collect()[0]
    return stats.select(group, "_gm"), r["o"], int(r["k"])


def predict_group_mean(df: DataFrame, model: tuple[DataFrame, float, int], group: str,
                       pred_col: str = "prediction"):
    means, overall, _ = model
    m = means.withColumnRenamed(group, "_g")
    out = lookup_join(df, m, df[group].eqNullSafe(m["_g"]), "left")
    return out.withColumn(pred_col, F.coalesce(F.col("_gm"), F.lit(overall))).drop("_g", "_gm")
