"""The queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlight.llm import chat_format, decontamination, language_id, line_dedup, near_dedup, packing, quality_classifier, quality_rules, secret_scan, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secret_scan.query,
        "op2_decontamination": decontamination.query,
        "op3_quality_rules": quality_rules.query,
        "op4_chat_format": chat_format.query,
        "op5_line_dedup": line_dedup.query,
        "op6_packing": packing.query,
        "op7_near_dedup": near_dedup.query,
        "op8_url_filters": url_filters.query,
        "op9_quality_classifier": quality_classifier.query,
        "op10_language_id": language_id.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE,
        "op4_chat_format": chat_format.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
        "op8_url_filters": url_filters.ORACLE,
    }
