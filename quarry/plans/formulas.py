"""Bind formula placeholders to table columns by hint lists, as a Spark job.

The hints are exploded to (formula, element, position, candidate), inner-joined
with the relation of available column names, the first matching hint per
element wins, and only formulas whose every element is bound are kept.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

# The stock formulas of the feature knowledge base.
STOCK_FORMULAS = [
    {"new_feature_name": "CE", "formula_template": "{C} + {Mn}/6 + ({Cr}+{Mo}+{V})/5 + ({Ni}+{Cu})/15",
     "mapping_hints": {"C": ["C", "ELM_C"], "Mn": ["Mn", "ELM_MN"], "Cr": ["Cr", "ELM_CR"], "Mo": ["Mo", "ELM_MO"],
                       "V": ["V", "ELM_V"], "Ni": ["Ni", "ELM_NI"], "Cu": ["Cu", "ELM_CU"]}},
    {"new_feature_name": "EX_TI", "formula_template": "{Ti} - 3.4 * {N}",
     "mapping_hints": {"Ti": ["Ti", "ELM_TI"], "N": ["N", "ELM_N"]}},
    {"new_feature_name": "AL_N_RATIO", "formula_template": "{Al} / {N}",
     "mapping_hints": {"Al": ["Al", "ELM_AL"], "N": ["N", "ELM_N"]}},
]


def resolve_mappings(spark: SparkSession, formulas: list[dict], columns: list[str]) -> list[dict]:
    """Return the formulas whose elements all map to a present column, with the mapping."""
    hints = [(i, el, pos, cand) for i, f in enumerate(formulas)
             for el, cands in f["mapping_hints"].items() for pos, cand in enumerate(cands)]
    if not hints:
        return []
    h = spark.createDataFrame(hints, "f int, element string, pos int, candidate string")
    cols = spark.createDataFrame([(c,) for c in columns], "candidate string")
    w = Window.partitionBy("f", "element").orderBy("pos")
    bound = (h.join(cols, "candidate", "inner")
              .withColumn("_r", F.row_number().over(w)).filter("_r = 1"))
    need = h.groupBy("f").agg(F.countDistinct("element").alias("need"))
    got = bound.groupBy("f").agg(F.countDistinct("element").alias("got"),
                                 F.map_from_entries(F.collect_list(F.struct("element", "candidate"))).alias("m"))
    full = need.join(got, "f").filter(F.col("need") == F.col("got")).orderBy("f").collect()
    out = []
    for r in full:
        f = dict(formulas[r["f"]])
        f["mapping"] = dict(r["m"])
        out.append(f)
    return out
