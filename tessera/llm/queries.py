"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import queries_exact, queries_html, queries_lines, queries_mixing, queries_near, queries_packing, queries_secrets, queries_sketch, queries_toxicity, queries_url

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": queries_secrets.op1_secret_scan,
        "op2_packing": queries_packing.op2_packing,
        "op3_exact_dedup": queries_exact.op3_exact_dedup,
        "op4_toxicity": queries_toxicity.op4_toxicity,
        "op5_url_filter": queries_url.op5_url_filter,
        "op6_source_mixing": queries_mixing.op6_source_mixing,
        "op7_line_dedup": queries_lines.op7_line_dedup,
        "op8_fingerprints": queries_sketch.op8_fingerprints,
        "op9_near_dedup": queries_near.op9_near_dedup,
        "op10_html_text": queries_html.op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": queries_secrets.SQL,
        "op3_exact_dedup": queries_exact.SQL,
        "op5_url_filter": queries_url.SQL,
        "op6_source_mixing": queries_mixing.SQL,
        "op7_line_dedup": queries_lines.SQL,
        "op9_near_dedup": queries_near.SQL,
    }
