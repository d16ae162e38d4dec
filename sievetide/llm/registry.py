"""The subpackage's queries, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, context_mix, line_dedup, mixing, near_dup, packing, pseudonyms, quality, secret_scan, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_secret_forest": secret_scan.op2_secret_forest,
    "op3_poisson_mix": mixing.op3_poisson_mix,
    "op4_feistel_pseudonyms": pseudonyms.op4_feistel_pseudonyms,
    "op5_audio_features": audio.op5_audio_features,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_bagminhash": near_dup.op7_bagminhash,
    "op8_length_buckets": packing.op8_length_buckets,
    "op9_context_mixing": context_mix.op9_context_mixing,
    "op10_line_winnow": line_dedup.op10_line_winnow,
}

ORACLES: dict[str, str] = {
    "op3_poisson_mix": mixing.mix_sql(),
    "op8_length_buckets": packing.pack_sql(),
    "op10_line_winnow": line_dedup.dedup_sql(),
}
