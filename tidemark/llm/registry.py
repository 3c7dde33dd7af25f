"""Queries of the corpus operators, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import codes, fim, jaccard, linedup, media, mixing, packing, pii, quality, sharding, suffix, tokens, urlfilter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [tokens.op1_token_counts, pii.op2_pii, jaccard.op3_jaccard_join, urlfilter.op4_url_filters, quality.op5_quality_rules, suffix.op6_suffix_dedup, sharding.op7_sharding, media.op8_media_columns, mixing.op9_mixing, packing.op10_packing, fim.op11_fill_in_middle, codes.op12_vector_codes, linedup.op13_line_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": urlfilter.OP4_SQL, "op9_mixing": mixing.OP9_SQL, "op11_fill_in_middle": fim.OP11_SQL, "op12_vector_codes": codes.OP12_SQL, "op13_line_dedup": linedup.OP13_SQL}
