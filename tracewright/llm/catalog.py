"""Queries of this subpackage by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import byte_bpe, fingerprint, media, near_dedup, near_dedup_sql, packing, quality, secret_scan, suffix_dedup, token_output, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_token_output": token_output.op4_token_output,
        "op5_url_filters": url_filter.op5_url_filters,
        "op6_quality_classifier": quality.op6_quality_classifier,
        "op7_media_columns": media.op7_media_columns,
        "op8_secret_scans": secret_scan.op8_secret_scans,
        "op9_fingerprints": fingerprint.op9_fingerprints,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": url_filter.OP5_SQL, "op10_minhash_near_dedup": near_dedup_sql.OP10_SQL}
