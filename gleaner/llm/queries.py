"""Registered queries of this folder and their SQL. Each query runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import embedding_join, exact_dedup, jaccard_join, line_dedup, line_rules, packing, periodic_runs, piece_codec, pii, quality, recurrent_lm, resampling, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": token_store.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_piece_codec": piece_codec.query,
        "op4_quality": quality.query,
        "op5_packing": packing.query,
        "op6_recurrent_lm": recurrent_lm.query,
        "op7_line_dedup": line_dedup.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_pii": pii.query,
        "op10_embedding_join": embedding_join.query,
        "op11_periodic_runs": periodic_runs.query,
        "op12_resampling": resampling.query,
        "op13_line_rules": line_rules.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_jaccard_join": jaccard_join.ORACLE_SQL,
        "op9_pii": pii.oracle_sql(),
        "op10_embedding_join": embedding_join.ORACLE_SQL,
        "op13_line_rules": line_rules.ORACLE_SQL,
    }
