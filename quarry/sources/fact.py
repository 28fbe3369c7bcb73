"""The wide fact table the modelling pipeline reads, mapped onto the test tables.

One row per line item: ``lineitem`` joined to ``part`` and ``orders`` with a
few nulls, placeholders and constant columns injected so every cleaning
operator has something to do. The joins are plain equi-joins: Catalyst prunes
the columns, the parquet scans only read what the projection needs, and AQE
turns a join into a broadcast only when the measured side is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import read_table

# Columns that identify a row; never features (K_PRICE equals the raw target).
KEY_COLUMNS = ["L_ORDERKEY", "L_LINENUMBER", "L_PARTKEY", "L_SUPPKEY", "K_PRICE"]
TIME_COLUMN = "REC_REVISE_TIME"


def _fact_columns() -> dict[str, Column]:
    ln = F.col("l_linenumber")
    qty = F.col("l_quantity")
    size = F.col("p_size").cast("double")
    return {
        "L_ORDERKEY": F.col("l_orderkey"),
        "L_LINENUMBER": ln,
        "L_PARTKEY": F.col("l_partkey"),
        "L_SUPPKEY": F.col("l_suppkey"),
        "K_PRICE": F.col("l_extendedprice"),
        "REC_REVISE_TIME": F.col("l_shipdate"),
        "SG_SIGN": F.col("p_brand"),
        "PRODUCT_UNIT_NO": F.col("l_returnflag"),
        "ST_NO": F.col("o_orderpriority"),
        "SIGN_CODE": F.col("p_type"),
        "PROD_NAME": F.col("p_name"),
        "LINE_FLAG": F.col("l_linestatus"),
        "ELM_C": F.when(F.col("l_discount") != 0, F.col("l_discount")),
        "ELM_MN": F.when(F.col("l_tax") != 0, F.col("l_tax")),
        "ELM_N": F.col("l_discount"),
        "QTY": qty,
        "SIZE_MM": size,
        "RETAIL": F.col("p_retailprice"),
        "SPARSE_A": F.when(ln >= 4, size),
        "SPARSE_B": F.when(ln == 7, qty),
        "RAW_FLAG": F.when(ln == 1, F.lit("null")).when(ln == 2, F.lit("(null)")).when(ln == 3, F.lit(" "))
         .when(ln == 4, F.lit("nan")).otherwise(F.col("l_returnflag")),
        "CONST_COL": F.lit("X"),
        "EMPTY_COL": F.lit(None).cast("string"),
        "TS_N": F.when(qty == 1, F.lit(None).cast("double")).when(qty == 2, F.lit(0.0))
         .otherwise(F.col("l_extendedprice")),
        "TS_SIG": (F.lit(300) + 4 * qty + 1500 * F.col("l_discount") - 800 * F.col("l_tax") + 2 * F.col("p_size"))
        .cast("double"),
    }


# Columns that need a table besides ``lineitem``.
FROM_PART = {"SG_SIGN", "SIGN_CODE", "PROD_NAME", "SIZE_MM", "RETAIL", "SPARSE_A", "TS_SIG"}
FROM_ORDERS = {"ST_NO"}


def fact(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The fact view, or only the given columns of it (in the given order).

    ``part`` and ``orders`` are joined only if one of their columns is asked for: every line
    item has its part and its order (the foreign keys are total), so a join that adds no
    column would add and drop no row either.
    """
    wanted = set(columns)
    rows = read_table(spark, sf_dir, "lineitem")
    if not wanted or wanted & FROM_PART:
        part = read_table(spark, sf_dir, "part")
        rows = rows.join(part, rows.l_partkey == part.p_partkey)
    if not wanted or wanted & FROM_ORDERS:
        orders = read_table(spark, sf_dir, "orders")
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey)
    made = _fact_columns()
    return rows.select(*[made[c].alias(c) for c in columns or made])


# The same view as DuckDB SQL, used by the oracle twins.
FACT_SQL = """
fact AS (
  SELECT l_orderkey AS L_ORDERKEY, l_linenumber AS L_LINENUMBER, l_partkey AS L_PARTKEY,
         l_suppkey AS L_SUPPKEY, l_extendedprice AS K_PRICE,
         l_shipdate AS REC_REVISE_TIME,
         p_brand AS SG_SIGN, l_returnflag AS PRODUCT_UNIT_NO, o_orderpriority AS ST_NO,
         p_type AS SIGN_CODE, p_name AS PROD_NAME, l_linestatus AS LINE_FLAG,
         nullif(l_discount, 0) AS ELM_C, nullif(l_tax, 0) AS ELM_MN,
         l_discount AS ELM_N, l_quantity AS QTY, CAST(p_size AS double) AS SIZE_MM,
         p_retailprice AS RETAIL,
         CASE WHEN l_linenumber >= 4 THEN CAST(p_size AS double) END AS SPARSE_A,
         CASE WHEN l_linenumber = 7 THEN l_quantity END AS SPARSE_B,
         CASE l_linenumber WHEN 1 THEN 'null' WHEN 2 THEN '(null)' WHEN 3 THEN ' '
              WHEN 4 THEN 'nan' ELSE l_returnflag END AS RAW_FLAG,
         'X' AS CONST_COL, CAST(NULL AS varchar) AS EMPTY_COL,
         CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN 0
              ELSE l_extendedprice END AS TS_N,
         CAST(300 + 4*l_quantity + 1500*l_discount - 800*l_tax + 2*p_size AS double) AS TS_SIG
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
)"""
