"""From raw documents to packed training sequences: five stages, each one operator of ``quarry.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, language, packing, quality
from quarry.llm.common import stored, table, without
from quarry.llm.tokens import default_tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity exceeds their language's threshold go, empty ones too."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.where("not keep").select("doc_id", "key"), by_text=True)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: texts without letters, and those that score below nearly
    all labelled rows of the language they are told to be, each scored by a model that did not see it."""
    model = language.learn(docs.where(~language.held_out()))
    least = language.least_scores(docs, ~language.held_out())
    told = language.identify(docs, model, lang_pred="__lang", score="__score")
    enough = F.lit(0.0)
    if least:
        enough = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in least.items() for v in pair]), F.col("__lang")), enough)
    return told.where((F.col("__lang") != language.UNDECIDED) & (F.col("__score") >= enough)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, words=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
