"""The registered queries of this subpackage and the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_exact_dedup, op2_toxicity, op3_embeddings, op4_language, op5_quality, op6_substrings, op7_minhash, op8_packing, op9_mixing, op10_licenses, op11_html, op12_search, op13_prefixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup.op1_exact_dedup,
    "op2_toxicity": op2_toxicity.op2_toxicity,
    "op3_embeddings": op3_embeddings.op3_embeddings,
    "op4_language": op4_language.op4_language,
    "op5_quality": op5_quality.op5_quality,
    "op6_substrings": op6_substrings.op6_substrings,
    "op7_minhash": op7_minhash.op7_minhash,
    "op8_packing": op8_packing.op8_packing,
    "op9_mixing": op9_mixing.op9_mixing,
    "op10_licenses": op10_licenses.op10_licenses,
    "op11_html": op11_html.op11_html,
    "op12_search": op12_search.op12_search,
    "op13_prefixes": op13_prefixes.op13_prefixes,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": op1_exact_dedup.ORACLE, "op9_mixing": op9_mixing.ORACLE, "op12_search": op12_search.ORACLE, "op13_prefixes": op13_prefixes.ORACLE}
