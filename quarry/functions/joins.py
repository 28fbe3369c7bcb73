"""Joins of a big table with a derived lookup whose size is measured first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lookups whose values take up to so many bytes are broadcast; beyond it the join
# shuffles and AQE's skew-join handling splits partitions of hot keys.
BROADCAST_MAX_BYTES = 16 << 20
ROW_BYTES = 32  # a row's own cost besides its values


def measured_bytes(df: DataFrame) -> int:
    """Rows and the lengths of their values as text, summed in one small aggregate."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(ROW_BYTES))
    return int(df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).collect()[0][0])


def lookup_join(big: DataFrame, small: DataFrame, cond, how: str = "left", max_bytes: int | None = None) -> DataFrame:
    """Join ``big`` to ``small``; broadcast ``small`` only if it is measured to be small.

    ``small`` should be materialised (a fitted map is), as it is read for its size, too.
    """
    limit = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    if measured_bytes(small) <= limit:
        return big.join(F.broadcast(small), cond, how)
    return big.join(small, cond, how)


def null_safe_eq(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
