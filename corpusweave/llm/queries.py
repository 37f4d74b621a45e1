"""Registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from corpusweave.llm import (
    chat_template, decontaminate, line_runs, lm_score, max_sketch, mixing, piece_table, pivot_codes, quality_forest, simhash,
    style_tree, token_store, url_cascade,
)
from corpusweave.llm.common import table

QUERIES = {
    "op1_simhash": lambda spark, folder: simhash.near_duplicates(table(spark, folder, "documents")),
    "op2_line_dedup": line_runs.line_dedup,
    "op3_mix_sources": mixing.mix_sources,
    "op4_lm_score": lm_score.lm_score,
    "op5_token_ids": token_store.token_ids,
    "op6_url_filter": url_cascade.url_filter,
    "op7_quality_rules": quality_forest.quality_rules,
    "op8_chat_format": chat_template.chat_format,
    "op9_decontaminate": decontaminate.decontaminate,
    "op10_html_extract": style_tree.html_extract,
    "op11_sentencepiece": piece_table.sentencepiece,
    "op12_vector_codes": pivot_codes.vector_codes,
    "op13_ranked_search": max_sketch.ranked_search,
}
ORACLE = {
    "op2_line_dedup": line_runs.ORACLE,
    "op6_url_filter": url_cascade.oracle(),
    "op8_chat_format": chat_template.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op12_vector_codes": pivot_codes.ORACLE,
    "op13_ranked_search": max_sketch.ORACLE,
}
