"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.decontaminate import op6_benchmark_decontamination
from holdfast.llm.language import op9_language_id
from holdfast.llm.line_dedup import OP5_SQL, op5_line_dedup
from holdfast.llm.packing import op7_best_fit_packing
from holdfast.llm.quality import op10_quality_rules
from holdfast.llm.secrets import op3_secret_scans
from holdfast.llm.simhash import op8_simhash_near_dedup
from holdfast.llm.token_count import op4_token_counts
from holdfast.llm.token_file import op2_token_output
from holdfast.llm.urls import op1_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_output": op2_token_output,
    "op3_secret_scans": op3_secret_scans,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL}
