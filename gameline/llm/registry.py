"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gameline.llm import byte_bpe, decontaminate, html_text, lexical, license_scan, lsh_forest, mixing, ngram_join, ppm, quality, suffix_dedup, token_align, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
        "op4_html_text": html_text.op4_html_text,
        "op5_quality": quality.op5_quality,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_mixing": mixing.op8_mixing,
        "op9_nearest": lsh_forest.op9_nearest,
        "op10_lm_scoring": ppm.op10_lm_scoring,
        "op11_token_align": token_align.op11_token_align,
        "op12_lexical_search": lexical.op12_lexical_search,
        "op13_byte_bpe": byte_bpe.op13_byte_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op8_mixing": mixing.OP8_SQL, "op12_lexical_search": lexical.OP12_SQL}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
