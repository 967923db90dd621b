"""The queries of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, html, language, minhash, packing, passages, quality, repeats, secrets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": embeddings.query,
        "op2_packing": packing.query,
        "op3_html_extraction": html.query,
        "op4_language_id": language.query,
        "op5_suffix_array_dedup": repeats.query,
        "op6_substring_dedup": passages.query,
        "op7_byte_bpe": bpe.query,
        "op8_quality_rules": quality.query,
        "op9_secret_scan": secrets.query,
        "op10_minhash_near_dedup": minhash.query,
    }


def oracle_sql() -> dict[str, str]:
    """None of these can be said in SQL; tests hold them against brute force."""
    return {}
