"""Column-expression helpers shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col_type(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def is_numeric(df: DataFrame, c: str) -> bool:
    return c in df.columns and isinstance(col_type(df, c), NUMERIC_TYPES)


def is_datetime(df: DataFrame, c: str) -> bool:
    return c in df.columns and isinstance(col_type(df, c), DATETIME_TYPES)


def is_boolean(df: DataFrame, c: str) -> bool:
    return c in df.columns and isinstance(col_type(df, c), T.BooleanType)


def safe_div(num, den) -> Column:
    """Division that yields NULL instead of raising under ANSI mode."""
    num = num if isinstance(num, Column) else F.lit(num)
    den = den if isinstance(den, Column) else F.lit(den)
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(c: Column, lo, hi) -> Column:
    """Clip to [lo, hi] keeping NULL (``greatest``/``least`` would turn NULL into a bound)."""
    x = c
    if lo is not None:
        x = F.greatest(F.lit(float(lo)), x)
    if hi is not None:
        x = F.least(F.lit(float(hi)), x)
    return F.when(c.isNotNull(), x)


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace/add columns in one projection, keeping column order."""
    cols = [new[c].alias(c) if c in new else F.col(quote(c)) for c in df.columns]
    cols += [v.alias(k) for k, v in new.items() if k not in df.columns]
    return df.select(*cols)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(quote(name))
