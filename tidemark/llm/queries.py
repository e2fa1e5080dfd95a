"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, html_extract, jaccard, mixing, pii, sharding, substrings, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_substrings": substrings.op2_substrings,
        "op3_html": html_extract.op3_html,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_topk": topk.op5_topk,
        "op6_warc": warc.op6_warc,
        "op7_sharding": sharding.op7_sharding,
        "op8_mixing": mixing.op8_mixing,
        "op9_jaccard": jaccard.op9_jaccard,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontam.OP1_SQL,
        "op2_substrings": substrings.OP2_SQL,
        "op5_topk": topk.OP5_SQL,
        "op6_warc": warc.OP6_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op9_jaccard": jaccard.OP9_SQL,
        "op10_pii": pii.OP10_SQL,
    }
