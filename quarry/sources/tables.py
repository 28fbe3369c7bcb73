"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a scale-factor directory (``<dir>/<name>.parquet``), NaN as NULL.

    The files' own layout decides the scan's partitions. Where a few small files should
    feed many cores (a benchmark on one machine), the setting ``quarry.scan.partitions``
    spreads every table's rows over so many partitions.
    """
    df = nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    spread = spark.conf.get("quarry.scan.partitions", None)
    return df.repartition(int(spread)) if spread else df


def with_upper_case_columns(df: DataFrame) -> DataFrame:
    """Upper-case every column name (a pure rename, no data movement)."""
    return df.toDF(*[c.upper() for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise floating NaN to NULL at ingest.

    Spark's ``avg``/``percentile`` propagate NaN while skipping NULL, and the
    pipeline treats both as missing, so one representation is kept.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
