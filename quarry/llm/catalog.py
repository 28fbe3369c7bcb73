"""Queries of this package and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quarry.llm import (ann, bitplane, chat, decontaminate, exact_dedup, html_text, jaccard, language, packing, periodic_runs, prefix_trie,
                        quality, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_vectors": ann.op1_nearest_vectors,
    "op2_chat_format": chat.op2_chat_format,
    "op3_language_id": language.op3_language_id,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_token_files": bitplane.op5_token_files,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_packing": packing.op7_packing,
    "op8_quality": quality.op8_quality,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_html_text": html_text.op10_html_text,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op2_chat_format": chat.SQL,
    "op4_jaccard_join": jaccard.SQL,
    "op6_url_filter": url_filter.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_exact_dedup": exact_dedup.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
