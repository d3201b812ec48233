"""Queries of the numbered operators and of the pipeline, and SQL for those that it can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hindcast.llm.chat import op5_chat_formatting
from hindcast.llm.codes import op12_vector_codes
from hindcast.llm.decontamination import op6_benchmark_decontamination
from hindcast.llm.interaction import op11_filter_audit
from hindcast.llm.language import op8_language_id
from hindcast.llm.merges import op13_byte_bpe
from hindcast.llm.mixing import op1_mixing_sources
from hindcast.llm.oracle import ORACLE
from hindcast.llm.pages import op9_html_extraction
from hindcast.llm.quality import op4_quality_rules
from hindcast.llm.similar import op2_jaccard_join
from hindcast.llm.substrings import op3_suffix_dedup
from hindcast.llm.tokens import op10_token_files
from hindcast.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing_sources": op1_mixing_sources,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op10_token_files": op10_token_files,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_byte_bpe": op13_byte_bpe,
}

__all__ = ["ORACLE", "QUERIES"]
