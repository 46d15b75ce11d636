"""Queries and DuckDB SQL of the operators of this sub-package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from looploom.llm import counts, lattice, lm, mixing, packing, quality, simhash, toxicity, urls, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_mcd": quality.op1_quality_mcd,
    "op2_pseudo_likelihood": lm.op2_pseudo_likelihood,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op4_packing_conversations": packing.op4_packing_conversations,
    "op5_lattice": lattice.op5_lattice,
    "op6_token_counts": counts.op6_token_counts,
    "op7_mixing": mixing.op7_mixing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_wavelet": wavelet.op9_wavelet,
    "op10_url_filter": urls.op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op10_url_filter": urls.OP10_SQL,
}
