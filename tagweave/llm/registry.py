"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, gam, interpolation, minmax, mixing, pii, quality_rules, token_store, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bootstrapped_pii": pii.op1_bootstrapped_pii,
        "op2_deleted_interpolation": interpolation.op2_deleted_interpolation,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_gam_quality": gam.op4_gam_quality,
        "op5_content_sort": exact_dedup.op5_content_sort,
        "op6_minmax_near_dedup": minmax.op6_minmax_near_dedup,
        "op7_warc_bundles": warc.op7_warc_bundles,
        "op8_repetition_rules": quality_rules.op8_repetition_rules,
        "op9_token_store": token_store.op9_token_store,
        "op10_byte_bpe": bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.mix_sql(), "op5_content_sort": exact_dedup.exact_dedup_sql(), "op6_minmax_near_dedup": minmax.near_dedup_sql(), "op7_warc_bundles": warc.warc_sql()}
