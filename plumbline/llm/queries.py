"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import chat, exact_dedup, infilling, license_scan, mixing, near_dedup, packing, quality, sentence_pieces, toxicity, url_filter, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_warc": warc.op6_warc,
    "op7_chat_format": chat.op7_chat_format,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
    "op12_whitening": whitening.op12_whitening,
    "op13_fill_in_middle": infilling.op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_mix_sources": mixing.ORACLE_SQL,
    "op5_url_filters": url_filter.oracle_sql(),
    "op6_warc": warc.ORACLE_SQL,
    "op7_chat_format": chat.ORACLE_SQL,
    "op9_quality_rules": quality.oracle_sql(),
    "op13_fill_in_middle": infilling.ORACLE_SQL,
}
