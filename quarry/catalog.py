"""Query catalogue: one Spark job per operator, each with a DuckDB SQL twin.

Every query reads the test tables (or the fact view derived from them) in
full. Floating outputs are rounded on both sides so that the order in which a
distributed sum adds its terms cannot change the compared value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import c as col
from quarry.functions.ranking import global_index
from quarry.operators import clean, encode, features, impute, outlier, profile, scale
from quarry.sources.fact import FACT_SQL, KEY_COLUMNS, TIME_COLUMN, fact
from quarry.sources.scan import Request, scan_filtered, substr_code_predicate
from quarry.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEY_SQL = "L_ORDERKEY, L_LINENUMBER, L_PARTKEY, L_SUPPKEY, K_PRICE"
NUMERIC_FEATURES = ["ELM_C", "ELM_MN", "ELM_N", "QTY", "SIZE_MM", "RETAIL", "SPARSE_A", "SPARSE_B"]
SPARSE_FEATURES = ["ELM_C", "ELM_MN", "SPARSE_A", "SPARSE_B"]
# The seven quality-metric codes (one is the target, the rest are dropped).
METRIC_CODES = ["TS_N", "BREAK_EL_N", "YS_EL_N", "RP02_N", "TOP_YS_N", "BOT_YS_N", "AGT_EL_N"]
# Fields documented as unsuitable features.
UNSUITABLE_FIELDS = ["ST_NO", "SIGN_LINE_NO"]


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def with_fact(sql: str) -> str:
    """Prefix the fact view; ``sql`` is either a SELECT or further CTEs followed by a SELECT."""
    body = sql.lstrip()
    sep = "\n" if body.upper().startswith("SELECT") else ",\n"
    return "WITH " + FACT_SQL.strip() + sep + body


def ts_str(x) -> F.Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


TS_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def keys() -> list:
    return [col(k) for k in KEY_COLUMNS]


def rnd(x, d=6):
    return F.round(x, d)


# --------------------------------------------------------------------------- S1, F1-F3

SCAN_REQUEST = dict(target_metric="TS_N", time_range="19980101-19981231",
                    sg_sign=["Brand#4", "Brand#19"], product_unit_no=["R"])


def _fact_cols_sql(exclude=(), ts_as_string=True) -> str:
    cols = ["L_ORDERKEY", "L_LINENUMBER", "L_PARTKEY", "L_SUPPKEY", "K_PRICE", "REC_REVISE_TIME",
            "SG_SIGN", "PRODUCT_UNIT_NO", "ST_NO", "SIGN_CODE", "PROD_NAME", "LINE_FLAG", "ELM_C",
            "ELM_MN", "ELM_N", "QTY", "SIZE_MM", "RETAIL", "SPARSE_A", "SPARSE_B", "RAW_FLAG",
            "CONST_COL", "EMPTY_COL", "TS_N", "TS_SIG"]
    out = []
    for x in cols:
        if x in exclude:
            continue
        out.append(f"{TS_SQL.format(x)} AS {x}" if (x == TIME_COLUMN and ts_as_string) else x)
    return ", ".join(out)


def _fact_out(df: DataFrame) -> DataFrame:
    return df.select(*[ts_str(col(x)).alias(x) if x == TIME_COLUMN else col(x) for x in df.columns])


@query("scan_filtered", with_fact(f"""
SELECT {_fact_cols_sql()} FROM fact
WHERE REC_REVISE_TIME >= TIMESTAMP '1998-01-01' AND REC_REVISE_TIME < TIMESTAMP '1999-01-01'
  AND SG_SIGN IN ('Brand#4', 'Brand#19') AND PRODUCT_UNIT_NO IN ('R')"""))
def q_scan_filtered(spark, d):
    return _fact_out(scan_filtered(fact(spark, d), Request(**SCAN_REQUEST)))


@query("scan_substr_code", with_fact(f"""
SELECT {KEY_SQL}, SIGN_CODE FROM fact WHERE substr(SIGN_CODE, 5, 2) IN ('DA', 'OM')"""))
def q_scan_substr_code(spark, d):
    f = fact(spark, d, *KEY_COLUMNS, "SIGN_CODE")
    return f.filter(substr_code_predicate("SIGN_CODE", ["DA", "OM"])).select(*keys(), "SIGN_CODE")


# --------------------------------------------------------------------------- F4-F12

@query("target_cleaning", with_fact("""
SELECT count(*) AS rows, count_if(TS_N IS NULL) AS null_target, count_if(TS_N = 0) AS zero_target,
       count_if(TS_N IS NOT NULL AND TS_N <> 0) AS remaining FROM fact"""))
def q_target_cleaning(spark, d):
    _, counts = clean.target_cleaning(fact(spark, d, "TS_N"), "TS_N")
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


@query("target_filtered", with_fact(f"""
SELECT {KEY_SQL}, TS_N FROM fact WHERE TS_N IS NOT NULL AND TS_N <> 0"""))
def q_target_filtered(spark, d):
    return clean.target_filter(fact(spark, d, *KEY_COLUMNS, "TS_N"), "TS_N")


@query("null_placeholders", with_fact(r"""
SELECT RAW_FLAG, count(*) AS n FROM (
  SELECT CASE WHEN regexp_matches(RAW_FLAG, '(?i)^\s*(null|\(null\)|nan)?\s*$') THEN NULL ELSE RAW_FLAG END AS RAW_FLAG
  FROM fact) GROUP BY RAW_FLAG"""))
def q_null_placeholders(spark, d):
    f = clean.normalize_placeholders(fact(spark, d, "RAW_FLAG"))
    return f.groupBy("RAW_FLAG").agg(F.count(F.lit(1)).alias("n"))


@query("null_placeholders_search", r"""
SELECT lang, count(*) AS docs, count_if(regexp_matches(text, '^\s*$|null|\(null\)|nan')) AS erased
FROM documents GROUP BY lang""")
def q_null_placeholders_search(spark, d):
    docs = read_table(spark, d, "documents").select("lang", "text")
    erased = clean.placeholder_to_null(F.col("text"), reference_compat=True).isNull()
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(erased).alias("erased"))


FACT_ALL = ["L_ORDERKEY", "L_LINENUMBER", "L_PARTKEY", "L_SUPPKEY", "K_PRICE", "REC_REVISE_TIME",
            "SG_SIGN", "PRODUCT_UNIT_NO", "ST_NO", "SIGN_CODE", "PROD_NAME", "LINE_FLAG", "ELM_C",
            "ELM_MN", "ELM_N", "QTY", "SIZE_MM", "RETAIL", "SPARSE_A", "SPARSE_B", "RAW_FLAG",
            "CONST_COL", "EMPTY_COL", "TS_N", "TS_SIG"]


def constant_columns_frame(df: DataFrame, exempt: list[str]) -> DataFrame:
    cols = [x for x in df.columns if x not in exempt]
    aggs = []
    for i, x in enumerate(cols):
        aggs += [F.count(col(x)).alias(f"n{i}"), (F.min(col(x)) == F.max(col(x))).alias(f"e{i}")]
    wide = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(f"n{i}").alias("non_null"),
                 ((F.col(f"n{i}") == 0) | F.col(f"e{i}")).alias("is_constant"))
        for i, x in enumerate(cols)]))
    return wide.select(stack.alias("s")).select("s.*")


@query("constant_columns", with_fact("\nUNION ALL\n".join(
    f"SELECT '{x}' AS \"column\", count({x}) AS non_null, count(DISTINCT {x}) <= 1 AS is_constant FROM fact"
    for x in FACT_ALL if x != "TS_N")))
def q_constant_columns(spark, d):
    return constant_columns_frame(fact(spark, d), exempt=["TS_N"])


@query("screened_projection", with_fact(f"SELECT {_fact_cols_sql(exclude=('ST_NO',))} FROM fact"))
def q_screened_projection(spark, d):
    out, _ = clean.screen_columns(fact(spark, d), "TS_N", METRIC_CODES, UNSUITABLE_FIELDS)
    return _fact_out(out)


@query("drop_sparse_rows", with_fact(f"""
SELECT {KEY_SQL}, round(ratio, 6) AS ratio FROM (
  SELECT *, ((ELM_C IS NULL)::int + (ELM_MN IS NULL)::int + (SPARSE_A IS NULL)::int
            + (SPARSE_B IS NULL)::int) / 4.0 AS ratio FROM fact) WHERE ratio <= 0.5"""))
def q_drop_sparse_rows(spark, d):
    f = fact(spark, d, *KEY_COLUMNS, *SPARSE_FEATURES)
    kept = clean.drop_rows_by_ratio(f, 0.5, features=SPARSE_FEATURES)
    return kept.select(*keys(), rnd(clean.row_missing_ratio(kept, SPARSE_FEATURES)).alias("ratio"))


@query("delete_column", with_fact(f"SELECT {_fact_cols_sql(exclude=('EMPTY_COL',))} FROM fact"))
def q_delete_column(spark, d):
    out, _, _ = clean.delete_column(fact(spark, d), "EMPTY_COL")
    return _fact_out(out)


@query("drop_null_rows", with_fact(f"SELECT {KEY_SQL}, ELM_C FROM fact WHERE ELM_C IS NOT NULL"))
def q_drop_null_rows(spark, d):
    out, _, _ = clean.delete_rows_with_missing_in_column(fact(spark, d, *KEY_COLUMNS, "ELM_C"), "ELM_C")
    return out


@query("time_sorted", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS idx FROM events""")
def q_time_sorted(spark, d):
    ev = read_table(spark, d, "events").select("event_id", "ts")
    return global_index(ev, ["ts", "event_id"], "idx").select("event_id", "idx")


# --------------------------------------------------------------------------- P1-P6

def _profile_numeric_sql(table: str, cols: list[str], cte: bool) -> str:
    vals = ", ".join(f"CAST({x} AS double) AS {x}" for x in cols)
    body = f"""
long AS (UNPIVOT (SELECT {vals} FROM {table}) ON {", ".join(cols)} INTO NAME k VALUE v),
tot AS (SELECT count(*) AS n FROM {table}),
st AS (SELECT k, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx,
              quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3,
              skewness(v) AS sk, kurtosis(v) AS ku FROM long GROUP BY k),
o AS (SELECT long.k, count_if(q3 > q1 AND (v < q1 - 1.5*(q3-q1) OR v > q3 + 1.5*(q3-q1))) AS n_out
      FROM long JOIN st USING (k) GROUP BY long.k),
names AS (SELECT unnest([{", ".join(f"'{x}'" for x in cols)}]) AS k)
SELECT names.k AS "column", round(mean, 3) AS mean, round(sd, 3) AS std, round(mn, 3) AS min,
       round(med, 3) AS median, round(mx, 3) AS max, round(sk, 3) AS skewness, round(ku, 3) AS kurtosis,
       CASE WHEN coalesce(st.n, 0) < tot.n THEN round((tot.n - coalesce(st.n, 0)) * 100.0 / tot.n, 2) END
         AS missing_percentage,
       CASE WHEN n_out > 0 THEN round(n_out * 100.0 / st.n, 2) END AS outlier_percentage
FROM names CROSS JOIN tot LEFT JOIN st ON names.k = st.k LEFT JOIN o ON names.k = o.k"""
    return with_fact(body) if cte else "WITH " + body.lstrip()


def _profile_numeric_frame(spark, df: DataFrame, cols: list[str]) -> DataFrame:
    rows = profile.profile_rows(df.select(*cols))
    keep = ["column", "mean", "std", "min", "median", "max", "skewness", "kurtosis",
            "missing_percentage", "outlier_percentage"]
    return spark.createDataFrame([{k: r[k] for k in keep} for r in rows],
                                 "column string, mean double, std double, min double, median double, "
                                 "max double, skewness double, kurtosis double, missing_percentage double, "
                                 "outlier_percentage double")


@query("profile_numeric", _profile_numeric_sql("fact", NUMERIC_FEATURES, cte=True))
def q_profile_numeric(spark, d):
    return _profile_numeric_frame(spark, fact(spark, d, *NUMERIC_FEATURES), NUMERIC_FEATURES)


@query("profile_events_value", _profile_numeric_sql("events", ["value"], cte=False))
def q_profile_events_value(spark, d):
    return _profile_numeric_frame(spark, read_table(spark, d, "events"), ["value"])


CATEGORICAL_PROFILE_COLS = ["SG_SIGN", "PRODUCT_UNIT_NO", "ST_NO", "SIGN_CODE", "PROD_NAME", "LINE_FLAG",
                            "RAW_FLAG", "CONST_COL", "EMPTY_COL"]


def _semantic_sql() -> str:
    parts = []
    for x in CATEGORICAL_PROFILE_COLS:
        parts.append(f"""SELECT '{x}' AS "column",
  CASE WHEN count({x}) = 0 THEN 'empty' WHEN count(DISTINCT {x}) = 2 THEN 'binary' ELSE 'categorical' END AS type,
  CASE WHEN count({x}) = 0 THEN NULL ELSE count(DISTINCT {x}) END AS cardinality,
  CASE WHEN count({x}) > 0 AND count(DISTINCT {x}) <= 10
       THEN array_to_string(list_sort(list(DISTINCT {x})), ',') END AS unique_values
FROM fact""")
    parts.append(f"""SELECT 'REC_REVISE_TIME' AS "column", 'datetime' AS type,
  count(DISTINCT REC_REVISE_TIME) AS cardinality, NULL AS unique_values FROM fact""")
    return with_fact("\nUNION ALL\n".join(parts))


@query("semantic_types", _semantic_sql())
def q_semantic_types(spark, d):
    df = fact(spark, d, *CATEGORICAL_PROFILE_COLS, TIME_COLUMN)
    rows = profile.profile_rows(df)
    return spark.createDataFrame([{k: r[k] for k in ("column", "type", "cardinality", "unique_values")}
                                  for r in rows],
                                 "column string, type string, cardinality long, unique_values string")


ROW_MISSING_COLS = ["ELM_C", "ELM_MN", "SPARSE_A", "SPARSE_B", "QTY", "SG_SIGN"]


def _row_missing_sql() -> str:
    n = len(ROW_MISSING_COLS)
    s = " + ".join(f"({x} IS NULL)::int" for x in ROW_MISSING_COLS)
    ths = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
    above = ", ".join(f"count_if(r > {t}) AS above_{str(t).replace('.', '_')}" for t in ths)
    return with_fact(f"""
SELECT count(*) AS rows, {n} AS features, round(sum(r) / count(*) * 100, 2) AS global_missing_pct,
       round(avg(r), 4) AS mean, round(quantile_cont(r, 0.5), 4) AS median,
       round(quantile_cont(r, 0.9), 4) AS p90, round(quantile_cont(r, 0.95), 4) AS p95,
       round(max(r), 4) AS max, {above}
FROM (SELECT ({s}) / {float(n)} AS r FROM fact)""")


@query("profile_row_missing", _row_missing_sql())
def q_profile_row_missing(spark, d):
    df = fact(spark, d, *ROW_MISSING_COLS)
    p = profile.row_missing_profile(df)
    row = {k.replace(".", "_"): v for k, v in p.items()}
    cols = ["rows", "features", "global_missing_pct", "mean", "median", "p90", "p95", "max"] + \
        [f"above_0_{t}" for t in (3, 4, 5, 6, 7, 8)]
    types = {"rows": "long", "features": "long"}
    schema = ", ".join(f"{c} {types.get(c, 'long' if c.startswith('above') else 'double')}" for c in cols)
    return spark.createDataFrame([tuple(row[c] for c in cols)], schema)


def _missing_topk_sql() -> str:
    cols = [x for x in FACT_ALL if x != "TS_N"]
    parts = [f"SELECT '{x}' AS \"column\", {i} AS pos, round(count_if({x} IS NULL) * 100.0 / count(*), 2) AS missing_pct "
             f"FROM fact" for i, x in enumerate(cols)]
    return with_fact('SELECT "column", missing_pct, rnk FROM (SELECT *, row_number() OVER '
                     '(ORDER BY missing_pct DESC, pos) AS rnk FROM (' + "\nUNION ALL\n".join(parts) +
                     ")) WHERE rnk <= 40")


@query("missing_topk", _missing_topk_sql())
def q_missing_topk(spark, d):
    top = profile.missing_topk(fact(spark, d), target="TS_N", k=40)
    # rank is computed over the (small, one row per column) missing table
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("missing_pct"), F.asc("pos"))
    return top.select("column", "missing_pct", F.row_number().over(w).alias("rnk"))


# --------------------------------------------------------------------------- I1-I6

def _fill_query(op, column: str, **params):
    def run(spark, d):
        f = fact(spark, d, *KEY_COLUMNS, column)
        out, _, _ = op(f, column, **params)
        return out.select(*keys(), rnd(col(column)).alias(column))
    return run


QUERIES["impute_mean"] = _fill_query(impute.impute_mean, "ELM_C")
ORACLE["impute_mean"] = with_fact(f"""
SELECT {KEY_SQL}, round(coalesce(ELM_C, avg(ELM_C) OVER ()), 6) AS ELM_C FROM fact""")
QUERIES["impute_median"] = _fill_query(impute.impute_median, "ELM_C")
ORACLE["impute_median"] = with_fact(f"""
SELECT {KEY_SQL}, round(coalesce(ELM_C, (SELECT quantile_cont(ELM_C, 0.5) FROM fact)), 6) AS ELM_C FROM fact""")
QUERIES["impute_constant"] = _fill_query(impute.impute_constant, "ELM_C", value=0)
ORACLE["impute_constant"] = with_fact(f"SELECT {KEY_SQL}, round(coalesce(ELM_C, 0), 6) AS ELM_C FROM fact")


@query("impute_mode", with_fact(f"""
SELECT {KEY_SQL},
  coalesce(SPARSE_A, (SELECT SPARSE_A FROM fact WHERE SPARSE_A IS NOT NULL GROUP BY SPARSE_A
                      ORDER BY count(*) DESC, SPARSE_A LIMIT 1)) AS SPARSE_A,
  coalesce(RAW_FLAG, (SELECT RAW_FLAG FROM (
      SELECT CASE WHEN regexp_matches(RAW_FLAG, '(?i)^\\s*(null|\\(null\\)|nan)?\\s*$') THEN NULL ELSE RAW_FLAG END
      AS RAW_FLAG FROM fact) WHERE RAW_FLAG IS NOT NULL GROUP BY RAW_FLAG ORDER BY count(*) DESC, RAW_FLAG LIMIT 1))
    AS RAW_FLAG
FROM (SELECT * REPLACE (CASE WHEN regexp_matches(RAW_FLAG, '(?i)^\\s*(null|\\(null\\)|nan)?\\s*$') THEN NULL
                             ELSE RAW_FLAG END AS RAW_FLAG) FROM fact)"""))
def q_impute_mode(spark, d):
    f = clean.normalize_placeholders(fact(spark, d, *KEY_COLUMNS, "SPARSE_A", "RAW_FLAG"))
    out, _, _ = impute.impute_most_frequent(f, ["SPARSE_A", "RAW_FLAG"])
    return out


EVENTS_WITH_NULLS_SQL = "ev AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events)"


def events_with_nulls(spark, d) -> DataFrame:
    ev = read_table(spark, d, "events")
    return ev.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.col("value"))
                     .cast("double").alias("value"))


@query("impute_auto", "WITH " + FACT_SQL.strip() + ", " + EVENTS_WITH_NULLS_SQL + """,
evs AS (SELECT skewness(value) AS sk, avg(value) AS mu, quantile_cont(value, 0.5) AS med FROM ev),
fs AS (SELECT skewness(ELM_C) AS sk, avg(ELM_C) AS mu, quantile_cont(ELM_C, 0.5) AS med FROM fact)
SELECT 'events' AS source, event_id AS id,
       round(coalesce(value, CASE WHEN abs(evs.sk) >= 1.0 THEN evs.med ELSE evs.mu END), 6) AS value
FROM ev, evs
UNION ALL
SELECT 'fact', L_ORDERKEY * 10 + L_LINENUMBER,
       round(coalesce(ELM_C, CASE WHEN abs(fs.sk) >= 1.0 THEN fs.med ELSE fs.mu END), 6)
FROM fact, fs""")
def q_impute_auto(spark, d):
    ev = events_with_nulls(spark, d)
    ev_out, _, _ = impute.impute_auto(ev, "value")
    f = fact(spark, d, "L_ORDERKEY", "L_LINENUMBER", "ELM_C").select((F.col("L_ORDERKEY") * 10 + F.col("L_LINENUMBER")).alias("id"), "ELM_C")
    f_out, _, _ = impute.impute_auto(f, "ELM_C")
    return (ev_out.select(F.lit("events").alias("source"), F.col("event_id").alias("id"), rnd(F.col("value")).alias("value"))
            .unionByName(f_out.select(F.lit("fact").alias("source"), "id", rnd(F.col("ELM_C")).alias("value"))))


@query("missing_indicator", with_fact(f"""
SELECT {KEY_SQL}, (ELM_C IS NULL)::int AS ELM_C_ismissing, (SPARSE_A IS NULL)::int AS SPARSE_A_ismissing FROM fact"""))
def q_missing_indicator(spark, d):
    f = fact(spark, d, *KEY_COLUMNS, "ELM_C", "SPARSE_A")
    out, _, _ = impute.add_missing_indicator(f, ["ELM_C", "SPARSE_A"])
    return out.drop("ELM_C", "SPARSE_A")


# --------------------------------------------------------------------------- O1-O2

@query("cap_outliers_iqr", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL
                            ELSE greatest(q1 - 1.5*(q3-q1), least(q3 + 1.5*(q3-q1), value)) END, 6) AS value
FROM events, q""")
def q_cap_outliers_iqr(spark, d):
    ev = read_table(spark, d, "events").select("event_id", "value")
    out, _, _ = outlier.cap_outliers_iqr(ev, "value")
    return out.select("event_id", rnd(F.col("value")).alias("value"))


@query("winsorize", """
WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE greatest(lo, least(hi, value)) END, 6) AS value
FROM events, q""")
def q_winsorize(spark, d):
    ev = read_table(spark, d, "events").select("event_id", "value")
    out, _, _ = outlier.winsorize_by_quantile(ev, "value")
    return out.select("event_id", rnd(F.col("value")).alias("value"))


# --------------------------------------------------------------------------- C1-C4

SCALE_COLS = ["QTY", "RETAIL", "ELM_C"]


def _scale_query(op):
    def run(spark, d):
        f = fact(spark, d, *KEY_COLUMNS, *SCALE_COLS)
        out, _, _ = op(f, SCALE_COLS)
        return out.select(*keys(), *[rnd(col(x)).alias(x) for x in SCALE_COLS])
    return run


QUERIES["standard_scale"] = _scale_query(scale.standard_scale_column)
ORACLE["standard_scale"] = with_fact(f"SELECT {KEY_SQL}, " + ", ".join(
    f"round(({x} - avg({x}) OVER ()) / coalesce(nullif(stddev_pop({x}) OVER (), 0), 1), 6) AS {x}"
    for x in SCALE_COLS) + " FROM fact")
QUERIES["min_max_scale"] = _scale_query(scale.min_max_scale_column)
ORACLE["min_max_scale"] = with_fact(f"SELECT {KEY_SQL}, " + ", ".join(
    f"round(({x} - min({x}) OVER ()) / coalesce(nullif(max({x}) OVER () - min({x}) OVER (), 0), 1), 6) AS {x}"
    for x in SCALE_COLS) + " FROM fact")
QUERIES["robust_scale"] = _scale_query(scale.robust_scale_column)
ORACLE["robust_scale"] = with_fact(
    "Q AS (SELECT " + ", ".join(
        f"quantile_cont({x}, 0.25) AS {x}_q1, quantile_cont({x}, 0.5) AS {x}_q2, quantile_cont({x}, 0.75) AS {x}_q3"
        for x in SCALE_COLS) + " FROM fact)\n" +
    f"SELECT {KEY_SQL}, " + ", ".join(
        f"round(({x} - {x}_q2) / coalesce(nullif({x}_q3 - {x}_q1, 0), 1), 6) AS {x}" for x in SCALE_COLS) +
    " FROM fact, Q")


def _yj_sql(x: str, lam: str) -> str:
    return (f"CASE WHEN {x} >= 0 THEN (CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) "
            f"ELSE (pow({x} + 1, {lam}) - 1) / {lam} END) "
            f"WHEN {x} < 0 THEN (CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {x}) "
            f"ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END) END")


@query("yeo_johnson_apply", f"SELECT event_id, round({_yj_sql('value', '0.25')}, 6) AS value FROM events")
def q_yeo_johnson_apply(spark, d):
    ev = read_table(spark, d, "events")
    return ev.select("event_id", rnd(scale.yeo_johnson(F.col("value"), 0.25)).alias("value"))


def _yj_fit_sql() -> str:
    # three nested grids, as the Spark fit: step .1 on [-2, 2], then .01 and .001 around the best
    def level(prev: str | None, step: float, name: str) -> str:
        if prev is None:
            grid = "SELECT round(-2.0::double + i * 0.1::double, 10) AS lam FROM range(41) t(i)"
        else:
            grid = (f"SELECT round(b.lam - {step * 10}::double + i * {step}::double, 10) AS lam "
                    f"FROM {prev} b, range(21) t(i)")
        return f"""
{name}_g AS ({grid}),
{name}_ll AS (SELECT g.lam, -count(value) / 2.0 * ln(var_pop({_yj_sql('value', 'g.lam')}))
                + (g.lam - 1) * sum(sign(value) * ln(1 + abs(value))) AS ll
              FROM {name}_g g, events GROUP BY g.lam),
{name} AS (SELECT lam FROM {name}_ll ORDER BY ll DESC, lam LIMIT 1)"""
    return ("WITH " + level(None, 0.1, "l0").strip() + "," + level("l0", 0.01, "l1") + "," +
            level("l1", 0.001, "l2") + "\nSELECT round((SELECT lam FROM l0), 4)::double AS lambda_grid, "
            "round((SELECT lam FROM l2), 4)::double AS lambda")


@query("yeo_johnson_fit", _yj_fit_sql())
def q_yeo_johnson_fit(spark, d):
    ev = read_table(spark, d, "events")
    grid = scale.fit_yeo_johnson_lambda(ev, "value", refinements=0)
    lam = scale.fit_yeo_johnson_lambda(ev, "value", refinements=2)
    return spark.createDataFrame([(round(grid, 4), round(lam, 4))], "lambda_grid double, lambda double")


# --------------------------------------------------------------------------- E1-E5

@query("one_hot", with_fact(f"""
SELECT {KEY_SQL},
  (PRODUCT_UNIT_NO IS NOT DISTINCT FROM 'A')::int AS PRODUCT_UNIT_NO_A,
  (PRODUCT_UNIT_NO IS NOT DISTINCT FROM 'N')::int AS PRODUCT_UNIT_NO_N,
  (PRODUCT_UNIT_NO IS NOT DISTINCT FROM 'R')::int AS PRODUCT_UNIT_NO_R,
  (F IS NOT DISTINCT FROM 'A')::int AS RAW_FLAG_A, (F IS NOT DISTINCT FROM 'N')::int AS RAW_FLAG_N,
  (F IS NOT DISTINCT FROM 'R')::int AS RAW_FLAG_R,
  (F IS NULL)::int AS RAW_FLAG_nan
FROM (SELECT *, CASE WHEN regexp_matches(RAW_FLAG, '(?i)^\\s*(null|\\(null\\)|nan)?\\s*$') THEN NULL
                     ELSE RAW_FLAG END AS F FROM fact)"""))
def q_one_hot(spark, d):
    f = clean.normalize_placeholders(fact(spark, d, *KEY_COLUMNS, "PRODUCT_UNIT_NO", "RAW_FLAG"))
    out, _, _ = encode.one_hot_encode_column(f, ["PRODUCT_UNIT_NO", "RAW_FLAG"])
    return out


@query("label_encode", with_fact(f"""
SELECT {KEY_SQL}, CAST(dense_rank() OVER (ORDER BY ST_NO) - 1 AS int) AS ST_NO FROM fact"""))
def q_label_encode(spark, d):
    out, _, _ = encode.label_encode_column(fact(spark, d, *KEY_COLUMNS, "ST_NO"), "ST_NO")
    return out


@query("target_encode", with_fact(f"""
t AS (SELECT * FROM fact WHERE TS_N IS NOT NULL AND TS_N <> 0),
p AS (SELECT avg(TS_N) AS prior FROM t),
s AS (SELECT SG_SIGN, count(TS_N) AS n, avg(TS_N) AS m FROM t GROUP BY SG_SIGN),
e AS (SELECT SG_SIGN, CASE WHEN n = 1 THEN prior
             ELSE prior * (1 - 1 / (1 + exp(-(n - 20) / 5.0))) + m * (1 / (1 + exp(-(n - 20) / 5.0))) END AS enc
      FROM s, p)
SELECT {KEY_SQL}, round(coalesce(e.enc, p.prior), 4) AS SG_SIGN FROM t LEFT JOIN e USING (SG_SIGN), p"""))
def q_target_encode(spark, d):
    f = clean.target_filter(fact(spark, d, *KEY_COLUMNS, "SG_SIGN", "TS_N"), "TS_N")
    out, _, _ = encode.target_encode_column(f, "SG_SIGN", target="TS_N")
    return out.select(*keys(), F.round(F.col("SG_SIGN"), 4).alias("SG_SIGN"))


@query("frequency_encode", with_fact(f"""
SELECT {KEY_SQL}, round(count(*) OVER (PARTITION BY PROD_NAME) / count(*) OVER (), 8) AS PROD_NAME FROM fact"""))
def q_frequency_encode(spark, d):
    out, _, _ = encode.frequency_encode_column(fact(spark, d, *KEY_COLUMNS, "PROD_NAME"), "PROD_NAME")
    return out.select(*keys(), F.round(F.col("PROD_NAME"), 8).alias("PROD_NAME"))


@query("rare_label_collapse", with_fact(f"""
SELECT {KEY_SQL}, CASE WHEN count(*) OVER (PARTITION BY PROD_NAME) / count(*) OVER () < 0.016
                       THEN '__RARE__' ELSE PROD_NAME END AS PROD_NAME FROM fact"""))
def q_rare_label_collapse(spark, d):
    out, _, _ = encode.rare_label_collapse(fact(spark, d, *KEY_COLUMNS, "PROD_NAME"), "PROD_NAME",
                                           min_freq=0.016)
    return out


# --------------------------------------------------------------------------- X1-X4

# The elements of the stock formulas, bound to fact columns.
CE_MAPPING = {"C": "ELM_C", "Mn": "ELM_MN", "Cr": "ELM_N", "Mo": "SPARSE_A", "V": "SPARSE_B",
              "Ni": "QTY", "Cu": "SIZE_MM"}
RATIO_MAPPING = {"Al": "QTY", "N": "ELM_N"}


@query("formula_feature", with_fact(f"""
SELECT {KEY_SQL},
  round(coalesce(ELM_C,0) + coalesce(ELM_MN,0)/6 + (coalesce(ELM_N,0)+coalesce(SPARSE_A,0)+coalesce(SPARSE_B,0))/5
        + (coalesce(QTY,0)+coalesce(SIZE_MM,0))/15, 6) AS CE,
  round(CASE WHEN coalesce(ELM_N,0) = 0 THEN NULL ELSE coalesce(QTY,0) / coalesce(ELM_N,0) END, 6) AS AL_N
FROM fact"""))
def q_formula_feature(spark, d):
    from quarry.plans.formulas import STOCK_FORMULAS
    f = fact(spark, d, *KEY_COLUMNS, "ELM_C", "ELM_MN", "ELM_N", "SPARSE_A", "SPARSE_B", "QTY", "SIZE_MM")
    f, _ = features.apply_formula(f, STOCK_FORMULAS[0]["formula_template"], "CE", CE_MAPPING)
    f, _ = features.apply_formula(f, STOCK_FORMULAS[2]["formula_template"], "AL_N", RATIO_MAPPING)
    return f.select(*keys(), rnd(F.col("CE")).alias("CE"), rnd(F.col("AL_N")).alias("AL_N"))


@query("polynomial_features", with_fact(f"""
SELECT {KEY_SQL}, QTY, ELM_C,
  round(coalesce(QTY,0)*coalesce(QTY,0), 6) AS "QTY^2",
  round(coalesce(QTY,0)*coalesce(ELM_C,0), 6) AS "QTY ELM_C",
  round(coalesce(ELM_C,0)*coalesce(ELM_C,0), 6) AS "ELM_C^2"
FROM fact"""))
def q_polynomial_features(spark, d):
    f = fact(spark, d, *KEY_COLUMNS, "QTY", "ELM_C")
    out, new = features.polynomial_features(f, ["QTY", "ELM_C"], degree=2)
    return out.select(*keys(), "QTY", "ELM_C", *[rnd(col(n)).alias(n) for n in new])


@query("interaction_features", with_fact(f"""
SELECT {KEY_SQL},
  round(coalesce(QTY,0), 6) AS QTY, round(coalesce(ELM_N,0), 6) AS ELM_N, round(coalesce(RETAIL,0), 6) AS RETAIL,
  round(coalesce(QTY,0)*coalesce(ELM_N,0), 6) AS "QTY ELM_N",
  round(coalesce(QTY,0)*coalesce(RETAIL,0), 6) AS "QTY RETAIL",
  round(coalesce(ELM_N,0)*coalesce(RETAIL,0), 6) AS "ELM_N RETAIL"
FROM fact"""))
def q_interaction_features(spark, d):
    f = fact(spark, d, *KEY_COLUMNS, "QTY", "ELM_N", "RETAIL")
    out, new = features.polynomial_features(f, ["QTY", "ELM_N", "RETAIL"], degree=2, interaction_only=True,
                                            keep_original=False)
    return out.select(*keys(), *[rnd(col(n)).alias(n) for n in new])


@query("ratio_feature", with_fact(f"""
SELECT {KEY_SQL}, round(CASE WHEN QTY IS NULL OR ELM_C IS NULL THEN NULL ELSE QTY / (ELM_C + 1e-6) END, 4)
  AS QTY_PER_C FROM fact"""))
def q_ratio_feature(spark, d):
    f = features.ratio_feature(fact(spark, d, *KEY_COLUMNS, "QTY", "ELM_C"), "QTY", "ELM_C", "QTY_PER_C")
    return f.select(*keys(), F.round(F.col("QTY_PER_C"), 4).alias("QTY_PER_C"))


# --------------------------------------------------------------------------- D1-D5

KEY_ORDER_SQL = "REC_REVISE_TIME, L_ORDERKEY, L_LINENUMBER, L_PARTKEY, L_SUPPKEY, K_PRICE"


@query("global_index", with_fact(f"""
SELECT {KEY_SQL}, row_number() OVER (ORDER BY {KEY_ORDER_SQL}) AS idx FROM fact"""))
def q_global_index(spark, d):
    from quarry.operators.split import add_time_index
    return add_time_index(fact(spark, d, *KEY_COLUMNS, TIME_COLUMN), TIME_COLUMN, KEY_COLUMNS).select(*keys(), "idx")


@query("split_sequential", with_fact(f"""
ix AS (SELECT {KEY_SQL}, row_number() OVER (ORDER BY {KEY_ORDER_SQL}) AS idx FROM fact),
n AS (SELECT count(*) AS n FROM fact)
SELECT {KEY_SQL}, idx, CASE WHEN idx <= floor(n * 0.8::double) THEN 'train' ELSE 'test' END AS split FROM ix, n"""))
def q_split_sequential(spark, d):
    from quarry.operators.split import add_time_index, split_sequential
    f = fact(spark, d, *KEY_COLUMNS, TIME_COLUMN)
    ix = add_time_index(f, TIME_COLUMN, KEY_COLUMNS)
    return split_sequential(ix, ix.count(), 0.2).select(*keys(), "idx", "split")


@query("folds_time_series", """
WITH ix AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS idx FROM events),
n AS (SELECT count(*) AS n, count(*) // 6 AS b FROM events),
f AS (SELECT i AS fold, n - (5 - i + 1) * b AS start, b FROM n, range(1, 6) t(i))
SELECT fold, count_if(idx <= start) AS train_rows, count_if(idx > start AND idx <= start + b) AS val_rows,
       min(CASE WHEN idx > start AND idx <= start + b THEN idx END) AS val_first,
       max(CASE WHEN idx > start AND idx <= start + b THEN idx END) AS val_last,
       max(CASE WHEN idx <= start THEN idx END) AS train_last
FROM ix, f GROUP BY fold""")
def q_folds_time_series(spark, d):
    from quarry.operators.split import tag_folds, time_series_folds
    ev = read_table(spark, d, "events").select("event_id", "ts")
    ix = global_index(ev, ["ts", "event_id"], "idx")
    n = ix.count()
    long = tag_folds(ix, time_series_folds(n, 5)).select("idx", "fold", "role")
    is_val = F.col("role") == "val"
    return long.groupBy("fold").agg(
        F.count_if(~is_val).alias("train_rows"), F.count_if(is_val).alias("val_rows"),
        F.min(F.when(is_val, F.col("idx"))).alias("val_first"), F.max(F.when(is_val, F.col("idx"))).alias("val_last"),
        F.max(F.when(~is_val, F.col("idx"))).alias("train_last"))


# The permutation of D3 and D5 is md5 over the seed and the row's own key.
SPLIT_KEYS = ["L_ORDERKEY", "L_LINENUMBER", "L_PARTKEY", "L_SUPPKEY"]
PERMUTED_SQL = """
p AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', L_ORDERKEY, L_LINENUMBER, L_PARTKEY, L_SUPPKEY))) AS r,
             count(*) OVER () AS n FROM fact)"""


@query("split_random", with_fact(PERMUTED_SQL + f"""
SELECT {KEY_SQL}, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM p"""))
def q_split_random(spark, d):
    from quarry.operators.split import split_random
    f = fact(spark, d, *KEY_COLUMNS)
    return split_random(f, SPLIT_KEYS, f.count(), 0.2)


@query("folds_random", with_fact(PERMUTED_SQL + f"""
SELECT {KEY_SQL}, CAST(CASE WHEN r <= (n // 5 + 1) * (n % 5) THEN (r - 1) // (n // 5 + 1)
                            ELSE n % 5 + (r - 1 - (n // 5 + 1) * (n % 5)) // (n // 5) END + 1 AS int) AS fold FROM p"""))
def q_folds_random(spark, d):
    from quarry.operators.split import random_folds
    f = fact(spark, d, *KEY_COLUMNS)
    return random_folds(f, SPLIT_KEYS, f.count(), 5)


# --------------------------------------------------------------------------- V1-V3, G1-G3, S4

MODEL_FRAME_SQL = f"""
t AS (SELECT * FROM fact WHERE TS_N IS NOT NULL AND TS_N <> 0),
ix AS (SELECT *, row_number() OVER (ORDER BY {KEY_ORDER_SQL}) AS idx FROM t),
cnt AS (SELECT count(*) AS n FROM t),
sp AS (SELECT ix.*, CASE WHEN idx <= floor(n * 0.8::double) THEN 'train' ELSE 'test' END AS split FROM ix, cnt),
gm AS (SELECT SG_SIGN, avg(TS_N) AS gm FROM sp WHERE split = 'train' GROUP BY SG_SIGN),
om AS (SELECT avg(TS_N) AS om FROM sp WHERE split = 'train'),
pr AS (SELECT sp.*, coalesce(gm.gm, om.om) AS prediction FROM sp LEFT JOIN gm USING (SG_SIGN), om)"""

METRICS_SQL = """count(*) AS n, round(avg((prediction - TS_N)^2), 0) AS mse, round(sqrt(avg((prediction - TS_N)^2)), 3) AS rmse,
  round(1 - sum((prediction - TS_N)^2) / (var_pop(TS_N) * count(TS_N)), 6) AS r2,
  round(avg(abs(prediction - TS_N)), 3) AS mae,
  round(avg((CASE WHEN TS_N <> 0 THEN abs(prediction - TS_N) / abs(TS_N) <= 0.05
                  ELSE abs(prediction - TS_N) <= 0 END)::int), 6) AS within_tolerance"""


def _model_frame(spark, d) -> DataFrame:
    from quarry.plans.flagship import modelling_frame
    return modelling_frame(spark, d)


def _round_metrics(df: DataFrame, *group) -> DataFrame:
    return df.select(*group, "n", F.round("mse", 0).alias("mse"), F.round("rmse", 3).alias("rmse"),
                     F.round("r2", 6).alias("r2"), F.round("mae", 3).alias("mae"),
                     F.round("within_tolerance", 6).alias("within_tolerance"))


@query("regression_metrics", with_fact(MODEL_FRAME_SQL + f"\nSELECT {METRICS_SQL} FROM pr WHERE split = 'test'"))
def q_regression_metrics(spark, d):
    from quarry.operators.evaluate import regression_metrics
    return _round_metrics(regression_metrics(_model_frame(spark, d).filter("split = 'test'"), "TS_N", "prediction"))


@query("metrics_by_split", with_fact(MODEL_FRAME_SQL + f"\nSELECT split, {METRICS_SQL} FROM pr GROUP BY split"))
def q_metrics_by_split(spark, d):
    from quarry.operators.evaluate import metrics_by_split
    return _round_metrics(metrics_by_split(_model_frame(spark, d), "TS_N", "prediction"), "split")


@query("within_tolerance", with_fact(MODEL_FRAME_SQL + """
SELECT 'percentage' AS tolerance_type, 5.0::double AS tolerance_value,
  round(avg((CASE WHEN TS_N <> 0 THEN abs(prediction - TS_N) / abs(TS_N) <= 0.05
                  ELSE abs(prediction - TS_N) <= 0 END)::int), 6) AS within_tolerance FROM pr WHERE split = 'test'
UNION ALL
SELECT 'value', 20000.0::double, round(avg((abs(prediction - TS_N) <= 20000)::int), 6) FROM pr WHERE split = 'test'"""))
def q_within_tolerance(spark, d):
    from quarry.operators.evaluate import within_band
    test = _model_frame(spark, d).filter("split = 'test'")
    tolerances = ({"type": "percentage", "value": 5.0}, {"type": "value", "value": 20000.0})
    share = lambda tol: F.round(F.avg(within_band(F.col("TS_N"), F.col("prediction"), tol).cast("double")), 6)
    wide = test.agg(*[share(tol).alias(f"w{i}") for i, tol in enumerate(tolerances)])  # both in one pass
    rows = [F.struct(F.lit(tol["type"]).alias("tolerance_type"), F.lit(tol["value"]).alias("tolerance_value"), F.col(f"w{i}").alias("within_tolerance"))
            for i, tol in enumerate(tolerances)]
    return wide.select(F.inline(F.array(*rows)))


@query("predictions_out", with_fact(MODEL_FRAME_SQL + f"""
SELECT {KEY_SQL}, TS_N AS true_TS_N, round(prediction, 4) AS predict_TS_N FROM pr WHERE split = 'test'"""))
def q_predictions_out(spark, d):
    test = _model_frame(spark, d).filter("split = 'test'")
    from quarry.sources.sinks import prediction_frame
    return prediction_frame(test.select(*keys(), "TS_N", F.round("prediction", 4).alias("prediction")), "TS_N")


@query("band_counts", with_fact(MODEL_FRAME_SQL + """,
f AS (SELECT CASE WHEN TS_N <> 0 THEN abs(prediction - TS_N) / abs(TS_N) <= 0.05
                  ELSE abs(prediction - TS_N) <= 0 END AS inb FROM pr WHERE split = 'test')
SELECT count(*) AS n, count_if(inb) AS in_band, count(*) - count_if(inb) AS out_band,
       round(count_if(inb) / count(*), 6) AS in_share FROM f"""))
def q_band_counts(spark, d):
    from quarry.operators.evaluate import band_counts
    b = band_counts(_model_frame(spark, d).filter("split = 'test'"), "TS_N", "prediction")
    return b.select("n", "in_band", "out_band", F.round("in_share", 6).alias("in_share"))


@query("error_histogram", with_fact(MODEL_FRAME_SQL + """,
e AS (SELECT (prediction - TS_N) / TS_N * 100 AS e FROM pr WHERE split = 'test' AND TS_N <> 0),
mm AS (SELECT min(e) AS lo, max(e) AS hi FROM e)
SELECT b AS bin, count(*) AS n FROM (
  SELECT least(50, CAST(floor((e - lo) / (hi - lo) * 50) AS int) + 1) AS b FROM e, mm) GROUP BY b"""))
def q_error_histogram(spark, d):
    from quarry.operators.evaluate import error_histogram
    return error_histogram(_model_frame(spark, d).filter("split = 'test'"), "TS_N", "prediction").select("bin", "n")


@query("value_histogram")
def q_value_histogram(spark, d):
    from quarry.operators.evaluate import value_histogram
    return value_histogram(_model_frame(spark, d).filter("split = 'test'"), "TS_N", "prediction")


ATTR_FEATURES = ["SG_SIGN", "ST_NO", "PRODUCT_UNIT_NO", "LINE_FLAG", "SIGN_CODE", "PROD_NAME"]


@query("mean_abs_topk", with_fact("""
t AS (SELECT * FROM fact WHERE TS_N IS NOT NULL AND TS_N <> 0),
om AS (SELECT avg(TS_N) AS om FROM t),
long AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{x}' AS feature, avg(TS_N) OVER (PARTITION BY {x}) - om AS contrib FROM t, om" for x in ATTR_FEATURES) + """)
SELECT feature, round(avg(abs(contrib)), 4) AS mean_abs, row_number() OVER (ORDER BY avg(abs(contrib)) DESC, feature) AS rnk
FROM long GROUP BY feature QUALIFY rnk <= 30"""))
def q_mean_abs_topk(spark, d):
    from quarry.operators.explain import long_contributions, mean_abs_topk
    t = clean.target_filter(fact(spark, d, "TS_N", *ATTR_FEATURES), "TS_N")
    long = long_contributions(t, ATTR_FEATURES, "TS_N")
    top = mean_abs_topk(long, weight_col="weight", k=30)
    return top.select("feature", F.round("mean_abs", 4).alias("mean_abs"), "rnk")


# --------------------------------------------------------------------------- R1-R3

PLAN_MISSING_COLS = ["SG_SIGN", "PRODUCT_UNIT_NO", "ELM_C", "ELM_MN", "ELM_N", "QTY", "SPARSE_A", "SPARSE_B",
                     "EMPTY_COL", "TS_N"]


@query("plan_missing", with_fact("""
m AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{x}' AS \"column\", {i} AS pos, count({x}) AS nn, count(*) AS n FROM fact"
    for i, x in enumerate(PLAN_MISSING_COLS) if x != "TS_N") + """),
p AS (SELECT "column", pos, nn, round((n - nn) * 100.0 / n, 2) AS mp FROM m)
SELECT "column", 1 AS seq, CASE WHEN nn = 0 OR mp > 40 THEN 'delete_column' ELSE 'impute_auto' END AS operation
FROM p WHERE mp > 0"""))
def q_plan_missing(spark, d):
    from quarry.plans.rules import missing_plan
    prof = profile.profile(fact(spark, d, *PLAN_MISSING_COLS), target="TS_N")
    return missing_plan(prof).select("column", "seq", "operation")


PLAN_REFINE_NUM = ["QTY", "SIZE_MM", "RETAIL", "ELM_N"]
PLAN_REFINE_CAT = ["SG_SIGN", "ST_NO", "PROD_NAME", "LINE_FLAG", "SIGN_CODE"]


def _plan_refine_sql() -> str:
    vals = ", ".join(f"CAST({x} AS double) AS {x}" for x in PLAN_REFINE_NUM)
    cats = "\nUNION ALL\n".join(f"SELECT '{x}' AS k, count(DISTINCT {x}) AS card FROM fact" for x in PLAN_REFINE_CAT)
    return with_fact(f"""
long AS (UNPIVOT (SELECT {vals} FROM fact) ON {", ".join(PLAN_REFINE_NUM)} INTO NAME k VALUE v),
st AS (SELECT k, skewness(v) AS sk, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY k),
o AS (SELECT long.k, count_if(q3 > q1 AND (v < q1 - 1.5*(q3-q1) OR v > q3 + 1.5*(q3-q1))) AS n_out
      FROM long JOIN st USING (k) GROUP BY long.k),
num AS (SELECT st.k, CASE WHEN abs(round(sk, 3)) > 1.5 THEN 'winsor' WHEN n_out > 0 THEN 'robust' ELSE 'standard' END AS kind
        FROM st JOIN o USING (k)),
cat AS ({cats}),
steps AS (
  SELECT k, 1 AS seq, 'winsorize_by_quantile' AS operation, '{{"lower_q":"0.01","upper_q":"0.99"}}' AS params FROM num WHERE kind = 'winsor'
  UNION ALL SELECT k, 2, 'standard_scale_column', '{{}}' FROM num WHERE kind = 'winsor'
  UNION ALL SELECT k, 1, 'robust_scale_column', '{{}}' FROM num WHERE kind = 'robust'
  UNION ALL SELECT k, 1, 'standard_scale_column', '{{}}' FROM num WHERE kind = 'standard'
  UNION ALL SELECT k, 1, CASE WHEN card = 2 THEN 'label_encode_column' WHEN card > 30 THEN 'rare_label_collapse'
                              ELSE 'label_encode_column' END,
                         CASE WHEN card > 30 AND card <> 2 THEN '{{"min_freq":"0.01"}}' ELSE '{{}}' END FROM cat
  UNION ALL SELECT k, 2, 'target_encode_column', '{{}}' FROM cat WHERE card > 30 AND card <> 2
  UNION ALL SELECT 'REC_REVISE_TIME', 1, 'delete_column', '{{}}')
SELECT k AS "column", seq, operation, params FROM steps""")


@query("plan_refine", _plan_refine_sql())
def q_plan_refine(spark, d):
    from quarry.plans.rules import refine_plan
    prof = profile.profile(fact(spark, d, *PLAN_REFINE_NUM, *PLAN_REFINE_CAT, TIME_COLUMN))
    plan = refine_plan(prof)
    return plan.select("column", "seq", "operation", F.to_json("params").alias("params"))


def _row_threshold_sql() -> str:
    cols = [x for x in FACT_ALL if x != "TS_N"]
    s = " + ".join(f"({x} IS NULL)::int" for x in cols)
    return with_fact(f"""
r AS (SELECT ({s}) / {float(len(cols))} AS r FROM fact),
q AS (SELECT round(quantile_cont(r, 0.9), 4) AS p90, round(quantile_cont(r, 0.95), 4) AS p95 FROM r)
SELECT p90, p95, least(0.9, greatest(0.3, CASE WHEN p95 >= 0.7 THEN 0.7 WHEN p90 >= 0.6 THEN 0.6 ELSE 0.5 END))::double
  AS threshold FROM q""")


@query("row_threshold", _row_threshold_sql())
def q_row_threshold(spark, d):
    from quarry.plans.rules import row_threshold
    p = profile.row_missing_profile(fact(spark, d), target="TS_N")
    return spark.createDataFrame([(p["p90"], p["p95"], float(row_threshold(p["p90"], p["p95"])))],
                                 "p90 double, p95 double, threshold double")


#: Columns that are often missing, so that both passes have rows to drop.
SPARSE = ["SPARSE_A", "SPARSE_B", "EMPTY_COL"]


def _row_threshold_twice_sql() -> str:
    s = " + ".join(f"({x} IS NULL)::int" for x in SPARSE)
    cut = ("least(0.9, greatest(0.3, CASE WHEN quantile_cont(r, 0.95) >= 0.7 THEN 0.7 WHEN quantile_cont(r, 0.9) >= 0.6 THEN 0.6 ELSE 0.5 END))::double")
    return with_fact(f"""
r1 AS (SELECT ({s}) / {float(len(SPARSE))} AS r FROM fact), t1 AS (SELECT {cut} AS t FROM r1),
r2 AS (SELECT r FROM r1, t1 WHERE r <= t), t2 AS (SELECT {cut} AS t FROM r2),
n AS (SELECT (SELECT count(*) FROM r1) - (SELECT count(*) FROM r2) AS n1, (SELECT count(*) FROM r2, t2 WHERE r > t) AS n2)
SELECT 1 AS pass, t AS threshold, n1 AS removed FROM t1, n UNION ALL SELECT 2, t, n2 FROM t2, n WHERE n1 > 0""")


@query("row_threshold_twice", _row_threshold_twice_sql())
def q_row_threshold_twice(spark, d):
    from quarry.plans.build import prune_sparse_rows
    _, cuts = prune_sparse_rows(fact(spark, d, *SPARSE), SPARSE, passes=2)
    return spark.createDataFrame([(i, float(x["threshold"]), int(x["removed"])) for i, x in enumerate(cuts, 1)],
                                 "pass int, threshold double, removed long")


# --------------------------------------------------------------------------- F14, X2, X5

# Listed out of canonical order on purpose: the executor must reorder.
EXECUTOR_PLAN = {
    "QTY": [{"operation": "standard_scale_column"},
            {"operation": "winsorize_by_quantile", "params": {"lower_q": 0.05, "upper_q": 0.95}}],
    "RETAIL": [{"operation": "min_max_scale_column"}],
    "ST_NO": [{"operation": "label_encode_column"}],
    "ELM_C": [{"operation": "impute_median"}],
    "SPARSE_B": [{"operation": "delete_column"}],
    "ELM_MN": [{"operation": "impute_mean"}, {"operation": "add_missing_indicator"}],
}


@query("plan_executor", with_fact(f"""
s1 AS (SELECT {KEY_SQL}, QTY, RETAIL, ST_NO, ELM_C, ELM_MN FROM fact),
s2 AS (SELECT *, (ELM_MN IS NULL)::int AS ELM_MN_ismissing FROM s1),
s3 AS (SELECT * REPLACE (coalesce(ELM_MN, (SELECT avg(ELM_MN) FROM s2)) AS ELM_MN) FROM s2),
s4 AS (SELECT * REPLACE (coalesce(ELM_C, (SELECT quantile_cont(ELM_C, 0.5) FROM s3)) AS ELM_C) FROM s3),
w AS (SELECT quantile_cont(QTY, 0.05) AS lo, quantile_cont(QTY, 0.95) AS hi FROM s4),
s5 AS (SELECT s4.* REPLACE (greatest(lo, least(hi, QTY)) AS QTY) FROM s4, w),
s6 AS (SELECT * REPLACE (CAST(dense_rank() OVER (ORDER BY ST_NO) - 1 AS int) AS ST_NO) FROM s5),
s7 AS (SELECT * REPLACE ((QTY - avg(QTY) OVER ()) / coalesce(nullif(stddev_pop(QTY) OVER (), 0), 1) AS QTY) FROM s6),
s8 AS (SELECT * REPLACE ((RETAIL - min(RETAIL) OVER ()) / coalesce(nullif(max(RETAIL) OVER () - min(RETAIL) OVER (), 0), 1)
                         AS RETAIL) FROM s7)
SELECT {KEY_SQL}, round(QTY, 6) AS QTY, round(RETAIL, 6) AS RETAIL, ST_NO, round(ELM_C, 6) AS ELM_C,
       round(ELM_MN, 6) AS ELM_MN, ELM_MN_ismissing FROM s8"""))
def q_plan_executor(spark, d):
    from quarry.plans.executor import execute_plan
    f = fact(spark, d, *KEY_COLUMNS, "QTY", "RETAIL", "ST_NO", "ELM_C", "ELM_MN", "SPARSE_B")
    out, logs, _ = execute_plan(f, EXECUTOR_PLAN, target="TS_N")
    failed = [lg for lg in logs if lg.status == "failed"]
    if failed:
        raise RuntimeError(f"plan steps failed: {failed}")
    return out.select(*keys(), *[rnd(col(x)).alias(x) for x in ("QTY", "RETAIL", "ELM_C", "ELM_MN")],
                      "ST_NO", "ELM_MN_ismissing")


FEATURE_PLAN = [
    {"operation": "create_polynomial_features",
     "params": {"columns": ["QTY", "ELM_N"], "degree": 2, "interaction_only": True}},
    {"operation": "create_ratio_features",
     "params": {"numerator_col": "QTY", "denominator_col": "RETAIL", "new_col_name": "QTY_RETAIL_RATIO"}},
    {"operation": "no_action"},
]


@query("feature_plan", with_fact(f"""
SELECT {KEY_SQL}, round(coalesce(QTY,0) * coalesce(ELM_N,0), 6) AS "QTY ELM_N",
       round(QTY / (RETAIL + 1e-6), 6) AS QTY_RETAIL_RATIO FROM fact"""))
def q_feature_plan(spark, d):
    from quarry.plans.executor import execute_feature_plan
    f = fact(spark, d, *KEY_COLUMNS, "QTY", "ELM_N", "RETAIL")
    out, logs, new = execute_feature_plan(f, FEATURE_PLAN)
    return out.select(*keys(), *[rnd(col(n)).alias(n) for n in new])


@query("formula_mapping", with_fact(f"""
SELECT {KEY_SQL}, round(coalesce(ELM_C, 0) + coalesce(ELM_MN, 0) / 6, 6) AS CEQ_C_MN FROM fact"""))
def q_formula_mapping(spark, d):
    from quarry.plans.formulas import STOCK_FORMULAS, resolve_mappings
    f = fact(spark, d, *KEY_COLUMNS, "ELM_C", "ELM_MN")
    # the fact table lacks Cr/Mo/V/Ni/Cu/Ti/Al: every stock formula is dropped; a reduced
    # carbon-equivalent over the mapped elements is kept
    formulas = STOCK_FORMULAS + [
        {"new_feature_name": "CEQ_C_MN", "formula_template": "{C} + {Mn}/6",
         "mapping_hints": {"C": ["C", "ELM_C"], "Mn": ["Mn", "ELM_MN"]}}]
    resolved = resolve_mappings(spark, formulas, FACT_ALL)
    out = f
    for r in resolved:
        out, _ = features.apply_formula(out, r["formula_template"], r["new_feature_name"], r["mapping"])
    new = [r["new_feature_name"] for r in resolved]
    return out.select(*keys(), *[rnd(col(n)).alias(n) for n in new])


# --------------------------------------------------------------------------- K1-K2

KNN_SQL_CTES = """
ex AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cen AS (SELECT label AS query_id, i, avg(x::double) AS m FROM ex GROUP BY label, i),
dist AS (SELECT c.query_id, e.vec_id, sum((e.x::double - c.m) * (e.x::double - c.m)) AS d
         FROM ex e JOIN cen c ON e.i = c.i GROUP BY c.query_id, e.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM dist QUALIFY rank <= 3)"""


@query("knn_l2", "WITH " + KNN_SQL_CTES.strip() + """
SELECT CAST(query_id AS bigint) AS query_id, vec_id, CAST(rank AS int) AS rank, round(d, 6) AS distance,
       round(1 / (1 + d), 6) AS score FROM top""")
def q_knn_l2(spark, d):
    from quarry.operators.retrieve import knn_l2, label_centroids
    emb = read_table(spark, d, "embeddings")
    hits = knn_l2(emb, label_centroids(emb), k=3)
    return hits.select("query_id", "vec_id", "rank", rnd(F.col("distance")).alias("distance"),
                       rnd(F.col("score")).alias("score"))


@query("knn_with_metadata", "WITH " + KNN_SQL_CTES.strip() + """
SELECT CAST(top.query_id AS bigint) AS query_id, top.vec_id, CAST(rank AS int) AS rank, e.label AS hit_label,
       round(1 / (1 + d), 6) AS similarity_score
FROM top JOIN embeddings e ON e.vec_id = top.vec_id""")
def q_knn_with_metadata(spark, d):
    from quarry.operators.retrieve import knn_l2, label_centroids, with_metadata
    emb = read_table(spark, d, "embeddings")
    hits = knn_l2(emb, label_centroids(emb), k=3)
    meta = emb.select("vec_id", F.col("label").alias("hit_label"))
    return with_metadata(hits, meta).select("query_id", "vec_id", "rank", "hit_label",
                                            rnd(F.col("score")).alias("similarity_score"))


# --------------------------------------------------------------------------- R4-R5

def _alias_values_sql() -> str:
    from quarry.plans.rules import METRIC_ALIASES
    return ", ".join(f"('{c}', '{a}')" for c, a in METRIC_ALIASES)


def _tolerance_defaults_sql() -> str:
    from quarry.plans.rules import TOLERANCE_DEFAULTS
    return ", ".join(f"('{c}', '{t}', {v})" for _, c, t, v in TOLERANCE_DEFAULTS)


MAP_METRIC_SQL = f"""
al AS (SELECT * FROM (VALUES {{aliases}}) t(code, alias)),
dt AS (SELECT doc_id, lower(trim(text)) AS t FROM documents),
cand AS (SELECT doc_id, code, alias, (t = lower(alias))::int AS ex FROM dt JOIN al
         ON length(t) > 0 AND (contains(t, lower(alias)) OR contains(lower(alias), t))),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ex DESC, length(alias) DESC, code) = 1),
mapped AS (SELECT d.doc_id, b.code AS metric_code, b.alias AS matched_alias, b.ex = 1 AS exact_match
           FROM documents d LEFT JOIN best b USING (doc_id))"""


@query("metric_alias_map", "WITH " + MAP_METRIC_SQL.strip().replace("{aliases}", "ALIASES") + """
SELECT doc_id, metric_code, matched_alias, exact_match FROM mapped""")
def q_metric_alias_map(spark, d):
    from quarry.plans.rules import map_metric
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return map_metric(docs, "doc_id", "text")


TOL_PATTERN_SQL = r"(?:±|正负|\+/-|\+-)\s*(\d+(?:\.\d+)?)\s*(%|％)?|(\d+(?:\.\d+)?)\s*(%|％)"


@query("tolerance_resolve", "WITH " + MAP_METRIC_SQL.strip().replace("{aliases}", "ALIASES") + f""",
df AS (SELECT * FROM (VALUES TOLDEFAULTS) t(code, dtype, dval)),
ex AS (SELECT m.doc_id, coalesce(m.metric_code, 'TS_N') AS metric_code,
              regexp_extract(d.text, '{TOL_PATTERN_SQL}', 1) AS pm, regexp_extract(d.text, '{TOL_PATTERN_SQL}', 2) AS pmp,
              regexp_extract(d.text, '{TOL_PATTERN_SQL}', 3) AS pc
       FROM mapped m JOIN documents d USING (doc_id)),
ty AS (SELECT *, CASE WHEN pm <> '' THEN pm WHEN pc <> '' THEN pc END AS num FROM ex)
SELECT doc_id, metric_code,
       coalesce(CASE WHEN pm <> '' AND pmp = '' THEN 'value' WHEN num IS NOT NULL THEN 'percentage' END, dtype, 'percentage')
         AS tolerance_type,
       coalesce(CAST(num AS double), dval, 5.0)::double AS tolerance_value,
       CASE WHEN num IS NOT NULL THEN 'user_request' WHEN df.code IS NOT NULL THEN 'config_default'
            ELSE 'generic_default' END AS tolerance_source
FROM ty LEFT JOIN df ON ty.metric_code = df.code""")
def q_tolerance_resolve(spark, d):
    from quarry.plans.rules import map_metric, resolve_tolerance
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    req = map_metric(docs, "doc_id", "text", keep=["text"]).select(
        "doc_id", "text", F.coalesce("metric_code", F.lit("TS_N")).alias("metric_code"))
    return resolve_tolerance(req, "text", "metric_code").select(
        "doc_id", "metric_code", "tolerance_type", "tolerance_value", "tolerance_source")


def _fill_sql_constants():
    for k in ("metric_alias_map", "tolerance_resolve"):
        ORACLE[k] = ORACLE[k].replace("ALIASES", _alias_values_sql()).replace("TOLDEFAULTS", _tolerance_defaults_sql())


_fill_sql_constants()


# --------------------------------------------------------------------------- L3

@query("run_id", with_fact("""
SELECT SG_SIGN, PRODUCT_UNIT_NO,
  replace(replace(concat_ws('_', 'TS_N',
      strftime(min(REC_REVISE_TIME), '%Y%m%d') || '-' || strftime(max(REC_REVISE_TIME), '%Y%m%d'),
      SG_SIGN, PRODUCT_UNIT_NO, string_agg(DISTINCT ST_NO, '-' ORDER BY ST_NO), '20240101120000', 'random_forest'),
    ' ', ''), '/', '-') AS run_id
FROM fact GROUP BY SG_SIGN, PRODUCT_UNIT_NO"""))
def q_run_id(spark, d):
    from quarry.plans.runlog import list_part, run_id_column
    g = fact(spark, d, "SG_SIGN", "PRODUCT_UNIT_NO", "ST_NO", TIME_COLUMN).groupBy("SG_SIGN", "PRODUCT_UNIT_NO").agg(
        F.min(TIME_COLUMN).alias("t0"), F.max(TIME_COLUMN).alias("t1"),
        F.array_sort(F.collect_set("ST_NO")).alias("st"))   # bounded by distinct ST_NO values
    tr = F.concat(F.date_format("t0", "yyyyMMdd"), F.lit("-"), F.date_format("t1", "yyyyMMdd"))
    rid = run_id_column("TS_N", tr, F.col("SG_SIGN"), F.col("PRODUCT_UNIT_NO"), list_part(F.col("st")), None,
                        "20240101120000", "random_forest")
    return g.select("SG_SIGN", "PRODUCT_UNIT_NO", rid.alias("run_id"))


# --------------------------------------------------------------------------- G3 oracle

ORACLE["value_histogram"] = with_fact(MODEL_FRAME_SQL + """,
long AS (SELECT 'actual' AS series, TS_N AS x FROM pr WHERE split = 'test'
         UNION ALL SELECT 'predicted', prediction FROM pr WHERE split = 'test'),
st AS (SELECT count(x) AS n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
       FROM long),
bw AS (SELECT *, CASE WHEN 2 * (q3 - q1) * pow(n, -1.0 / 3) > 0
                      THEN least(2 * (q3 - q1) * pow(n, -1.0 / 3), (hi - lo) / (log2(n) + 1))
                      ELSE (hi - lo) / (log2(n) + 1) END AS w FROM st),
nb AS (SELECT lo, hi, greatest(1, CAST(ceil((hi - lo) / w) AS int)) AS bins FROM bw)
SELECT series, CAST(least(bins, floor((x - lo) / (hi - lo) * bins) + 1) AS int) AS bin, count(*) AS n
FROM long, nb GROUP BY ALL""")


# --------------------------------------------------------------------------- M1-M5, H1-H4, A1

MODEL_FEATURES = ["QTY", "ELM_N", "ELM_C", "ELM_MN", "SIZE_MM", "RETAIL"]


def _learning_frame(spark, d) -> DataFrame:
    """Target-cleaned fact with imputed features, time index and sequential split (persisted)."""
    from quarry.operators.split import add_time_index, split_sequential
    from quarry.session import on_disk
    f = clean.target_filter(fact(spark, d, *KEY_COLUMNS, TIME_COLUMN, *MODEL_FEATURES, "TS_SIG", "TS_N"), "TS_N")
    # the fill statistics, the range sample and the index checkpoint all read these
    # rows: join the sources once (a recomputation yields the same set of rows)
    f = joined = on_disk(f.drop("TS_N"))
    try:
        f, _, _ = impute.impute_auto(f, ["ELM_C", "ELM_MN"])
        ix = add_time_index(f, TIME_COLUMN, KEY_COLUMNS)
    finally:
        joined.unpersist()  # the numbered rows are in files
    return split_sequential(ix, ix.count(), 0.2)


def _fit_predict(learner: str, params: dict):
    def run(spark, d):
        from quarry.operators import learners
        frame = _learning_frame(spark, d)
        m = learners.fit(learner, frame.filter("split = 'train'"), MODEL_FEATURES, "TS_SIG", params)
        pred = m.predict(frame.filter("split = 'test'"))
        return pred.select(*keys(), "TS_SIG", F.round("prediction", 4).alias("prediction"))
    return run


QUERIES["rf_fit_predict"] = _fit_predict("random_forest", {"n_estimators": 10, "max_depth": 5})
QUERIES["gbt_fit_predict"] = _fit_predict("xgboost", {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.3})
QUERIES["leaf_gbt_fit_predict"] = _fit_predict("lightgbm", {"n_estimators": 10, "num_leaves": 15,
                                                             "learning_rate": 0.3})


@query("tree_importance")
def q_tree_importance(spark, d):
    from quarry.operators import learners
    frame = _learning_frame(spark, d)
    m = learners.fit("random_forest", frame.filter("split = 'train'"), MODEL_FEATURES, "TS_SIG",
                     {"n_estimators": 10, "max_depth": 5})
    return m.importances(spark)


def _search_query(learner: str, method: str, space: dict, n_iter: int):
    def run(spark, d):
        from quarry.operators.search import rank_trials, run_search, trials_frame
        from quarry.operators.split import time_series_folds
        frame = _learning_frame(spark, d)
        train = frame.filter("split = 'train'")
        n = train.count()
        # training indices are 1..n (the sequential split keeps the first rows)
        folds = time_series_folds(n, 3)
        trials, _ = run_search(learner, train, MODEL_FEATURES, "TS_SIG", space, method=method, n_iter=n_iter,
                               folds=folds, scoring="neg_mean_squared_error")
        return rank_trials(trials_frame(spark, trials))
    return run


QUERIES["grid_search"] = _search_query("random_forest", "grid", {"n_estimators": [5, 10], "max_depth": [3, 5]}, 0)
QUERIES["random_search"] = _search_query("xgboost", "random", {"n_estimators": [5, 15], "max_depth": [2, 5],
                                                               "learning_rate": [0.05, 0.5, "log"]}, 3)
QUERIES["adaptive_search"] = _search_query("random_forest", "adaptive", {"n_estimators": [5, 15],
                                                                         "max_depth": [2, 6]}, 5)


TRIAL_GROUPS = ["SG_SIGN", "ST_NO", "PRODUCT_UNIT_NO"]


def _trial_ranking_sql() -> str:
    trials = "\nUNION ALL\n".join(
        f"""SELECT {i} AS trial, f.fold, avg((coalesce(g.gm, om.om) - v.TS_N)^2) AS mse
FROM folds f JOIN ix v ON v.idx > f.start AND v.idx <= f.start + f.b
LEFT JOIN (SELECT f2.fold, t.{x} AS k, avg(t.TS_N) AS gm FROM folds f2 JOIN ix t ON t.idx <= f2.start
           GROUP BY f2.fold, t.{x}) g ON g.fold = f.fold AND g.k IS NOT DISTINCT FROM v.{x}
JOIN (SELECT f3.fold, avg(t.TS_N) AS om FROM folds f3 JOIN ix t ON t.idx <= f3.start GROUP BY f3.fold) om
  ON om.fold = f.fold
GROUP BY f.fold""" for i, x in enumerate(TRIAL_GROUPS))
    return with_fact(f"""
t AS (SELECT * FROM fact WHERE TS_N IS NOT NULL AND TS_N <> 0),
ix AS (SELECT *, row_number() OVER (ORDER BY {KEY_ORDER_SQL}) AS idx FROM t),
n AS (SELECT count(*) AS n, count(*) // 4 AS b FROM t),
folds AS (SELECT i AS fold, n - (3 - i + 1) * b AS start, b FROM n, range(1, 4) tt(i)),
sc AS ({trials})
SELECT trial, round(avg(-mse), 2) AS mean_score, count(*) AS folds,
       row_number() OVER (ORDER BY avg(-mse) DESC, trial) AS rank FROM sc GROUP BY trial""")


@query("trial_ranking", _trial_ranking_sql())
def q_trial_ranking(spark, d):
    """H4 over a search whose trials are group-mean predictors (one grouping column each),
    scored by time-series cross-validation — deterministic, so SQL can check it."""
    from quarry.operators.baseline import fit_group_mean, predict_group_mean
    from quarry.operators.evaluate import metric_exprs
    from quarry.operators.search import rank_trials
    from quarry.operators.split import add_time_index, time_series_folds
    t = clean.target_filter(fact(spark, d, *KEY_COLUMNS, TIME_COLUMN, "TS_N", *TRIAL_GROUPS), "TS_N")
    # every trial and fold passes over these columns only, decoded once
    ix = add_time_index(t, TIME_COLUMN, KEY_COLUMNS).select("idx", "TS_N", *TRIAL_GROUPS).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        folds = time_series_folds(ix.count(), 3)
        for trial, g in enumerate(TRIAL_GROUPS):
            for f in folds:
                tr = ix.filter(F.col("idx") <= f["train_hi"])
                va = ix.filter(F.col("idx").between(f["val_lo"], f["val_hi"]))
                pred = predict_group_mean(va, fit_group_mean(tr, g, "TS_N"), g)
                mse = pred.agg(*metric_exprs("TS_N", "prediction")).collect()[0]["mse"]
                rows.append((trial, f["fold"], -float(mse)))
    finally:
        ix.unpersist()
    scores = spark.createDataFrame(rows, "trial int, fold int, score double")
    r = rank_trials(scores)
    return r.select("trial", F.round("mean_score", 2).alias("mean_score"), "folds", "rank")


@query("shap_values")
def q_shap_values(spark, d):
    from quarry.operators import learners
    from quarry.operators.explain import shap_values
    frame = _learning_frame(spark, d)
    train = frame.filter("split = 'train'")
    m = learners.fit("random_forest", train, MODEL_FEATURES, "TS_SIG", {"n_estimators": 5, "max_depth": 4})
    sv = shap_values(m.model, train, MODEL_FEATURES, KEY_COLUMNS)
    return sv.select(*keys(), "shap", F.round("expected", 6).alias("expected"))


@query("shap_importance")
def q_shap_importance(spark, d):
    """A1 + A2: mean |SHAP| per feature over the training rows, top 30."""
    from quarry.operators import learners
    from quarry.operators.explain import mean_abs_topk, shap_long, shap_values
    frame = _learning_frame(spark, d)
    train = frame.filter("split = 'train'")
    m = learners.fit("random_forest", train, MODEL_FEATURES, "TS_SIG", {"n_estimators": 5, "max_depth": 4})
    long = shap_long(shap_values(m.model, train, MODEL_FEATURES, KEY_COLUMNS), MODEL_FEATURES, KEY_COLUMNS)
    return mean_abs_topk(long, k=30)


# --------------------------------------------------------------------------- G4

@query("shap_summary")
def q_shap_summary(spark, d):
    """A1 + A2 + G4: the summary plot's points for the top features of a small forest."""
    from quarry.operators import learners
    from quarry.operators.explain import mean_abs_topk, shap_long, shap_summary_points, shap_values
    from quarry.session import materialize
    frame = _learning_frame(spark, d)
    train = frame.filter("split = 'train'")
    m = learners.fit("random_forest", train, MODEL_FEATURES, "TS_SIG", {"n_estimators": 5, "max_depth": 4})
    sv = materialize(shap_values(m.model, train, MODEL_FEATURES, KEY_COLUMNS, carry=MODEL_FEATURES))
    top = mean_abs_topk(shap_long(sv, MODEL_FEATURES, KEY_COLUMNS), k=30)
    pts = shap_summary_points(sv, top, MODEL_FEATURES, KEY_COLUMNS)
    return pts.select(*keys(), "feature", F.round("shap", 6).alias("shap"), "feature_value", "rnk")


# --------------------------------------------------------------------------- P2, P6

def _profile_categorical_sql() -> str:
    parts = []
    for x in CATEGORICAL_PROFILE_COLS + [TIME_COLUMN]:
        is_dt = x == TIME_COLUMN
        other_type = "'datetime'" if is_dt else "'categorical'"
        uniq = "NULL" if is_dt else (f"CASE WHEN count(DISTINCT {x}) <= 10 "
                                     f"THEN array_to_string(list_sort(list(DISTINCT {x})), ',') END")
        dt = (f"strftime(min({x}), '%Y-%m-%dT%H:%M:%S')", f"strftime(max({x}), '%Y-%m-%dT%H:%M:%S')") \
            if is_dt else ("NULL", "NULL")
        parts.append(f"""SELECT '{x}' AS "column",
  CASE WHEN count({x}) = 0 THEN 'empty' WHEN count(DISTINCT {x}) = 2 THEN 'binary' ELSE {other_type} END AS type,
  CASE WHEN count({x}) > 0 AND count({x}) < count(*)
       THEN round((count(*) - count({x})) * 100.0 / count(*), 2) END AS missing_percentage,
  CASE WHEN count({x}) > 0 THEN count(DISTINCT {x}) END AS cardinality,
  CASE WHEN count({x}) = 0 THEN NULL
       WHEN count(DISTINCT {x}) = 2 THEN array_to_string(list_sort(list(DISTINCT {x}::varchar)), ',')
       ELSE {uniq} END AS unique_values,
  CASE WHEN count(DISTINCT {x}) <> 2 THEN {dt[0]} END AS dt_min,
  CASE WHEN count(DISTINCT {x}) <> 2 THEN {dt[1]} END AS dt_max
FROM fact""")
    return with_fact("\nUNION ALL\n".join(parts))


@query("profile_categorical", _profile_categorical_sql())
def q_profile_categorical(spark, d):
    """P2 + P6 for the non-numeric columns: type, missing share, cardinality, the values
    of low-cardinality columns and the range of datetimes."""
    df = fact(spark, d, *CATEGORICAL_PROFILE_COLS, TIME_COLUMN)
    keep = ["column", "type", "missing_percentage", "cardinality", "unique_values", "dt_min", "dt_max"]
    rows = []
    for r in profile.profile_rows(df):
        rec = {k: r[k] for k in keep}
        if rec["type"] != "datetime":
            rec["dt_min"] = rec["dt_max"] = None
        rows.append(rec)
    return spark.createDataFrame(rows, "column string, type string, missing_percentage double, cardinality long, "
                                       "unique_values string, dt_min string, dt_max string")


# --------------------------------------------------------------------------- L5

# A plan whose steps succeed or are skipped depending on the data.
LOG_PLAN = {
    "ELM_C": [{"operation": "impute_mean"}],
    "QTY": [{"operation": "impute_median"}],
    "SPARSE_A": [{"operation": "cap_outliers_iqr"}],
    "CONST_COL": [{"operation": "cap_outliers_iqr"}],
    "EMPTY_COL": [{"operation": "impute_most_frequent"}],
    "NOT_A_COLUMN": [{"operation": "impute_mean"}],
    "PROD_NAME": [{"operation": "rare_label_collapse", "params": {"min_freq": 0.016}}],
}


@query("plan_step_logs", with_fact("""
q AS (SELECT count(*) AS n, count_if(ELM_C IS NULL) AS elm_c_null, count_if(QTY IS NULL) AS qty_null,
             quantile_cont(SPARSE_A, 0.75) - quantile_cont(SPARSE_A, 0.25) AS sparse_iqr,
             count(EMPTY_COL) AS empty_nn FROM fact),
rare AS (SELECT count(*) AS n_rare FROM (SELECT PROD_NAME, count(*) AS c FROM fact GROUP BY PROD_NAME)
         WHERE c / (SELECT count(*) FROM fact) < 0.016)
SELECT 'ELM_C' AS "column", 'impute_mean' AS operation,
       CASE WHEN elm_c_null > 0 THEN 'applied' ELSE 'skipped' END AS status,
       CASE WHEN elm_c_null > 0 THEN '' ELSE 'no missing values' END AS message FROM q
UNION ALL SELECT 'QTY', 'impute_median', CASE WHEN qty_null > 0 THEN 'applied' ELSE 'skipped' END,
       CASE WHEN qty_null > 0 THEN '' ELSE 'no missing values' END FROM q
UNION ALL SELECT 'SPARSE_A', 'cap_outliers_iqr', CASE WHEN sparse_iqr > 0 THEN 'applied' ELSE 'skipped' END,
       CASE WHEN sparse_iqr > 0 THEN '' ELSE 'IQR is 0' END FROM q
UNION ALL SELECT 'CONST_COL', 'cap_outliers_iqr', 'skipped', 'not numeric'
UNION ALL SELECT 'EMPTY_COL', 'impute_most_frequent', CASE WHEN empty_nn > 0 THEN 'applied' ELSE 'skipped' END,
       CASE WHEN empty_nn > 0 THEN '' ELSE 'all values missing' END FROM q
UNION ALL SELECT 'NOT_A_COLUMN', 'impute_mean', 'skipped', 'column absent'
UNION ALL SELECT 'PROD_NAME', 'rare_label_collapse', CASE WHEN n_rare > 0 THEN 'applied' ELSE 'skipped' END,
       CASE WHEN n_rare > 0 THEN '' ELSE 'no rare values' END FROM rare"""))
def q_plan_step_logs(spark, d):
    """Per-step log rows of a plan run over the fact table (status decided by the data)."""
    from quarry.plans.executor import execute_plan, logs_frame
    f = fact(spark, d, *KEY_COLUMNS, "ELM_C", "QTY", "SPARSE_A", "CONST_COL", "EMPTY_COL", "PROD_NAME")
    _, logs, _ = execute_plan(f, LOG_PLAN, target="TS_N")
    return logs_frame(spark, logs).select("column", "operation", "status", "message")


# --------------------------------------------------------------------------- end to end (§3.1)

@query("model_build_metrics")
def q_model_build_metrics(spark, d):
    """A whole build from a request over the full fact view: screening, row and column
    cleaning by rule, train-only fitted preprocessing, features, sequential split, forest
    fit, metrics per split (explanation left to ``shap_values``)."""
    from quarry.plans.build import build_model
    src = fact(spark, d).drop("TS_N")
    res = build_model(spark, src, {"target_metric": "TS_SIG", "time_range": "19000101-29991231"},
                      key_cols=[k for k in KEY_COLUMNS if k != "K_PRICE"], time_col=TIME_COLUMN,
                      learner="random_forest", params={"n_estimators": 10, "max_depth": 5},
                      other_targets=["K_PRICE"], unsuitable=UNSUITABLE_FIELDS, explain=False)
    if res.status != "success":
        raise RuntimeError(res.package.get("error"))
    counts, n = res.package["target_cleaning"], res.package["rows_used"]
    if sum(res.package["metrics"][s]["n"] for s in ("train", "test")) != n or n > counts["remaining"]:
        raise RuntimeError("rows were lost between cleaning and the metrics")
    return res.metrics.select("split", *[F.round(c, 4).alias(c) for c in res.metrics.columns if c != "split"])


# --------------------------------------------------------------------------- checks that SQL can make of learners and sinks

# One tree of one split on few-valued features: the best split is exact, so SQL finds it, too.
STUMP_FEATURES = ["ELM_N", "SIZE_MM", "QTY"]
STUMP = {"n_estimators": 1, "max_depth": 1, "bootstrap": False, "max_bins": 64}
STUMP_SQL = MODEL_FRAME_SQL + """,
tr AS (SELECT *, avg(TS_SIG) OVER () AS om FROM sp WHERE split = 'train'),
c AS (""" + " UNION ALL ".join(f"SELECT '{x}' AS f, CAST({x} AS double) AS v, TS_SIG AS y FROM tr" for x in STUMP_FEATURES) + """),
g AS (SELECT f, v, count(*) AS n, sum(y) AS s FROM c GROUP BY f, v),
w AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nxt, sum(n) OVER (PARTITION BY f ORDER BY v) AS nl,
             sum(s) OVER (PARTITION BY f ORDER BY v) AS sl, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s FROM g),
best AS (SELECT *, (v + nxt) / 2 AS cut, sl / nl AS ml, (s - sl) / (n - nl) AS mr FROM w WHERE nxt IS NOT NULL
         ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1)"""


def _stump(spark, d):
    from quarry.operators import learners
    from quarry.operators.split import add_time_index, split_sequential
    f = clean.target_filter(fact(spark, d, *KEY_COLUMNS, TIME_COLUMN, *STUMP_FEATURES, "TS_SIG", "TS_N"), "TS_N")
    ix = add_time_index(f, TIME_COLUMN, KEY_COLUMNS)
    frame = split_sequential(ix, ix.count(), 0.2)
    return frame, learners.fit("random_forest", frame.filter("split = 'train'"), STUMP_FEATURES, "TS_SIG", STUMP)


@query("stump_predict", with_fact(STUMP_SQL + f"""
SELECT {KEY_SQL}, round(CASE WHEN (CASE best.f WHEN 'ELM_N' THEN ELM_N WHEN 'SIZE_MM' THEN SIZE_MM ELSE QTY END) <= cut
                             THEN ml ELSE mr END, 3) AS prediction FROM sp, best WHERE split = 'test'"""))
def q_stump_predict(spark, d):
    """M1 + M4: an exact one-split tree on the training rows, applied to the test rows."""
    frame, m = _stump(spark, d)
    return m.predict(frame.filter("split = 'test'")).select(*keys(), F.round("prediction", 3).alias("prediction"))


@query("stump_importance", with_fact(STUMP_SQL + """
SELECT x AS feature, CASE WHEN x = f THEN 1.0 ELSE 0.0 END::double AS importance
FROM best, (VALUES ('ELM_N'), ('SIZE_MM'), ('QTY')) t(x)"""))
def q_stump_importance(spark, d):
    """M5: the feature of the only split has all of the importance."""
    _, m = _stump(spark, d)
    return m.importances(spark)


@query("stump_shap", with_fact(STUMP_SQL + f""",
e AS (SELECT (nl * ml + (n - nl) * mr) / n AS expected FROM best)
SELECT {KEY_SQL}, best.f AS feature, round((CASE WHEN (CASE best.f WHEN 'ELM_N' THEN ELM_N WHEN 'SIZE_MM' THEN SIZE_MM ELSE QTY END) <= cut
       THEN ml ELSE mr END) - expected, 3) AS shap, round(expected, 3) AS expected FROM sp, best, e WHERE split = 'test'"""))
def q_stump_shap(spark, d):
    """A1: with one split, its feature's attribution is the leaf's value less the mean of all."""
    from quarry.operators.explain import shap_long, shap_values
    frame, m = _stump(spark, d)
    sv = shap_values(m.model, frame.filter("split = 'test'"), STUMP_FEATURES, KEY_COLUMNS)
    long = shap_long(sv, STUMP_FEATURES, KEY_COLUMNS).filter("abs(shap) > 1e-9")
    return long.join(sv.select(*KEY_COLUMNS, "expected"), KEY_COLUMNS).select(
        *keys(), "feature", F.round("shap", 3).alias("shap"), F.round("expected", 3).alias("expected"))


@query("stump_summary", with_fact(STUMP_SQL + f""",
e AS (SELECT (nl * ml + (n - nl) * mr) / n AS expected FROM best),
sv AS (SELECT sp.*, (CASE WHEN (CASE best.f WHEN 'ELM_N' THEN ELM_N WHEN 'SIZE_MM' THEN SIZE_MM ELSE QTY END) <= cut THEN ml ELSE mr END) - expected AS phi,
              best.f AS bf FROM sp, best, e WHERE split = 'test'),
pts AS (""" + " UNION ALL ".join(
    f"SELECT *, '{x}' AS feature, CASE WHEN bf = '{x}' THEN phi ELSE 0 END AS v, CAST({x} AS double) AS feature_value FROM sv" for x in STUMP_FEATURES) + f"""),
top AS (SELECT feature, row_number() OVER (ORDER BY avg(abs(v)) DESC, feature) AS rnk FROM pts GROUP BY feature)
SELECT {KEY_SQL}, feature, round(v, 3) AS shap, feature_value, CAST(rnk AS int) AS rnk FROM pts JOIN top USING (feature)
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY md5(concat_ws('|', feature, L_ORDERKEY, L_LINENUMBER, L_PARTKEY, L_SUPPKEY))) <= 100"""))
def q_stump_summary(spark, d):
    """At most 100 points of each feature, drawn by hash."""
    from quarry.operators.explain import mean_abs_topk, shap_long, shap_summary_points, shap_values
    from quarry.session import materialize
    frame, m = _stump(spark, d)
    sv = materialize(shap_values(m.model, frame.filter("split = 'test'"), STUMP_FEATURES, KEY_COLUMNS, carry=STUMP_FEATURES))
    top = mean_abs_topk(shap_long(sv, STUMP_FEATURES, KEY_COLUMNS), k=30)
    pts = shap_summary_points(sv, top, STUMP_FEATURES, KEY_COLUMNS, points=100, drawn_by=SPLIT_KEYS)
    return pts.select(*keys(), "feature", F.round("shap", 3).alias("shap"), "feature_value", "rnk")


# One round of each booster on few-valued features: SQL finds the same splits from sums of residuals.
def _splits_sql(rows: str, least: int, l2: float) -> str:
    """Every split of every node (column ``node``) of ``rows`` with its gain."""
    cols = " UNION ALL ".join(f"SELECT node, '{x}' AS f, CAST({x} AS double) AS v, r FROM {rows}" for x in STUMP_FEATURES)
    return f"""(SELECT *, (v + nxt) / 2 AS cut, gl * gl / (nl + {l2}) + (g - gl) * (g - gl) / (n - nl + {l2}) - g * g / (n + {l2}) AS gain
  FROM (SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nxt, sum(k) OVER (PARTITION BY node, f ORDER BY v) AS nl,
               sum(s) OVER (PARTITION BY node, f ORDER BY v) AS gl, sum(k) OVER (PARTITION BY node, f) AS n, sum(s) OVER (PARTITION BY node, f) AS g
        FROM (SELECT node, f, v, count(*) AS k, sum(r) AS s FROM ({cols}) GROUP BY node, f, v))
  WHERE nxt IS NOT NULL AND nl >= {least} AND n - nl >= {least})"""


def _side_sql(best: str) -> str:
    return f"CASE {best}.f WHEN 'ELM_N' THEN ELM_N WHEN 'SIZE_MM' THEN SIZE_MM ELSE QTY END <= {best}.cut"


BOOST_ROWS_SQL = MODEL_FRAME_SQL + """,
base AS (SELECT avg(TS_SIG) AS b FROM sp WHERE split = 'train'),
tr AS (SELECT *, TS_SIG - b AS r, 0 AS node FROM sp, base WHERE split = 'train')"""


def _one_round(learner: str, params: dict):
    def run(spark, d):
        from quarry.operators import learners
        from quarry.operators.split import add_time_index, split_sequential
        f = clean.target_filter(fact(spark, d, *KEY_COLUMNS, TIME_COLUMN, *STUMP_FEATURES, "TS_SIG", "TS_N"), "TS_N")
        ix = add_time_index(f, TIME_COLUMN, KEY_COLUMNS)
        frame = split_sequential(ix, ix.count(), 0.2)
        m = learners.fit(learner, frame.filter("split = 'train'"), STUMP_FEATURES, "TS_SIG", params)
        return m.predict(frame.filter("split = 'test'")).select(*keys(), F.round("prediction", 3).alias("prediction"))
    return run


QUERIES["gbt_one_round"] = _one_round("xgboost", {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.5, "reg_lambda": 1})
ORACLE["gbt_one_round"] = with_fact(BOOST_ROWS_SQL + f""",
best AS (SELECT * FROM {_splits_sql('tr', 1, 1.0)} ORDER BY gain DESC LIMIT 1)
SELECT {KEY_SQL}, round(b + 0.5 * CASE WHEN {_side_sql('best')} THEN gl / (nl + 1) ELSE (g - gl) / (n - nl + 1) END, 3) AS prediction
FROM sp, base, best WHERE split = 'test'""")

QUERIES["leaf_gbt_one_round"] = _one_round("lightgbm", {"n_estimators": 1, "num_leaves": 3, "learning_rate": 1.0})
ORACLE["leaf_gbt_one_round"] = with_fact(BOOST_ROWS_SQL + f""",
best AS (SELECT * FROM {_splits_sql('tr', 20, 0.0)} ORDER BY gain DESC LIMIT 1),
kids AS (SELECT tr.* REPLACE (CASE WHEN {_side_sql('best')} THEN 1 ELSE 2 END AS node) FROM tr, best),
second AS (SELECT * FROM {_splits_sql('kids', 20, 0.0)} ORDER BY gain DESC LIMIT 1),
placed AS (SELECT sp.*, CASE WHEN {_side_sql('best')} THEN 1 ELSE 2 END AS node FROM sp, best)
SELECT {KEY_SQL}, round(b + CASE WHEN placed.node = second.node THEN CASE WHEN {_side_sql('second')} THEN second.gl / second.nl
    ELSE (second.g - second.gl) / (second.n - second.nl) END
  WHEN placed.node = 1 THEN best.gl / best.nl ELSE (best.g - best.gl) / (best.n - best.nl) END, 3) AS prediction
FROM placed, base, best, second WHERE split = 'test'""")


@query("shap_additivity", with_fact(MODEL_FRAME_SQL + f"""
SELECT {KEY_SQL}, CAST(0 AS double) AS gap FROM sp WHERE split = 'train'"""))
def q_shap_additivity(spark, d):
    """A1: attributions and expected value add up to the forest's prediction in every row."""
    from quarry.operators import learners
    from quarry.operators.explain import shap_values
    train = _learning_frame(spark, d).filter("split = 'train'")
    m = learners.fit("random_forest", train, MODEL_FEATURES, "TS_SIG", {"n_estimators": 5, "max_depth": 4})
    sv = shap_values(m.model, train, MODEL_FEATURES, KEY_COLUMNS)
    total = F.aggregate("shap", F.col("expected"), lambda a, x: a + x)
    both = m.predict(train).select(*keys(), "prediction").join(sv, KEY_COLUMNS)
    return both.select(*keys(), F.abs(F.round(total - F.col("prediction"), 4)).alias("gap"))


@query("band_points", with_fact(MODEL_FRAME_SQL + f"""
SELECT {KEY_SQL}, TS_N AS actual, round(prediction, 4) AS predicted, CASE WHEN TS_N <> 0 THEN abs(prediction - TS_N) / abs(TS_N) <= 0.05
       ELSE abs(prediction - TS_N) <= 0 END AS in_band FROM pr WHERE split = 'test'"""))
def q_band_points(spark, d):
    """G1: the points of the actual-against-predicted plot."""
    from quarry.operators.evaluate import band_points
    pts = band_points(_model_frame(spark, d).filter("split = 'test'"), "TS_N", "prediction", KEY_COLUMNS)
    return pts.withColumn("predicted", F.round("predicted", 4))


@query("profile_events_ts", """
SELECT count(DISTINCT ts) AS cardinality, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS dt_min,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS dt_max FROM events""")
def q_profile_events_ts(spark, d):
    """P2 + P6 on times with fractions of a second."""
    r = profile.profile_rows(read_table(spark, d, "events").select("ts"))[0]
    whole = lambda v: v if "." in v else v + ".000000"
    return spark.createDataFrame([(r["cardinality"], whole(r["dt_min"]), whole(r["dt_max"]))], "cardinality long, dt_min string, dt_max string")


@query("run_summary", """
SELECT CAST(user_id AS varchar) AS run_id, min(ts)::timestamp AS start_time, max(ts)::timestamp AS end_time,
       max_by(event_type, event_id) AS final_status, count(*) AS n_stages FROM events GROUP BY user_id""")
def q_run_summary(spark, d):
    """L2 over the events as stage records: a user as run, the event's type as stage and status."""
    from quarry.plans.runlog import run_summary
    ev = read_table(spark, d, "events")
    stages = ev.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"),
                       "ts", F.col("event_type").alias("status"), F.lit("").alias("details"))
    return run_summary(stages).select("run_id", "start_time", "end_time", "final_status", "n_stages")


@query("upper_case_names", "SELECT EVENT_ID, USER_ID, VALUE FROM (SELECT event_id AS EVENT_ID, user_id AS USER_ID, value AS VALUE FROM events)")
def q_upper_case_names(spark, d):
    """A table under upper-case names."""
    from quarry.sources.tables import with_upper_case_columns
    return with_upper_case_columns(read_table(spark, d, "events").select("event_id", "user_id", "value"))


@query("excess_titanium", with_fact(f"""
SELECT {KEY_SQL}, round(coalesce(ELM_C, 0) - 3.4 * coalesce(ELM_N, 0), 6) AS excess FROM fact"""))
def q_excess_titanium(spark, d):
    """X1b bound to fact columns: the titanium slot to ELM_C, the nitrogen slot to ELM_N."""
    from quarry.plans import formulas
    f = fact(spark, d, *KEY_COLUMNS, "ELM_C", "ELM_N")
    out, _ = features.apply_formula(f, formulas.STOCK_FORMULAS[1]["formula_template"], "excess", {"Ti": "ELM_C", "N": "ELM_N"})
    return out.select(*keys(), rnd(F.col("excess")).alias("excess"))
