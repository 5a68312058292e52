"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwood.llm import bpe, chat, ctw, divergence, html, langid, media, packing, quality, resample, sharding, simhash, suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_media_columns": media.op2_media_columns,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_sharding": sharding.op6_sharding,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_html_extraction": html.op8_html_extraction,
    "op9_language_id": langid.op9_language_id,
    "op10_lm_scoring": ctw.op10_lm_scoring,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_suffix_array_dedup": suffix.op13_suffix_array_dedup,
}

ORACLE_SQL: dict[str, str] = {"op5_chat_formatting": chat.OP5_SQL, "op11_source_divergence": divergence.OP11_SQL}
