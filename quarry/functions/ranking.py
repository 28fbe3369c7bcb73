"""A global 1-based row index in a total order, without a single-partition window.

``row_number() over (order by ...)`` with no partition moves every row into one
task. Instead the rows are range-partitioned on the ordering key (Spark samples
the key to pick balanced bounds, so a timestamp shared by a third of the rows
is still split by the tie-break columns), sorted inside each partition and
numbered locally with ``monotonically_increasing_id``; a per-partition count
(one row per partition, a bounded broadcast) gives each partition its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize


def global_index(df: DataFrame, order_cols: list[str], index_col: str = "idx",
                 num_partitions: int | None = None, reliable: bool = True) -> DataFrame:
    """Append ``index_col`` = 1..n in ``order_cols`` order (the order must be total).

    The numbered frame is checkpointed (``reliable``) so that every later action
    (splits, folds, fits) sees the same numbering even if executors are lost.
    """
    spark = df.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols)
    tagged = (ordered.withColumn("_pid", F.spark_partition_id())
                     .withColumn("_mono", F.monotonically_increasing_id()))
    tagged = materialize(tagged, reliable=reliable)
    counts = tagged.groupBy("_pid").agg(F.min("_mono").alias("_m0"), F.count(F.lit(1)).alias("_cnt"))
    # bounded by the number of partitions: a safe broadcast
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_m0", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    out = (tagged.join(F.broadcast(offsets), "_pid")
                 .withColumn(index_col, F.col("_off") + F.col("_mono") - F.col("_m0") + 1)
                 .drop("_pid", "_mono", "_m0", "_off"))
    return out
