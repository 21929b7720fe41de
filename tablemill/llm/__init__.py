"""Operators for training-data pipelines over text."""

from __future__ import annotations

from tablemill.llm import bpe, chat, decontaminate, fingerprints, html_extract, licenses, minhash_dedup, passages, token_counts, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_html_extraction": html_extract.op5_html_extraction,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_minhash_near_dedup": minhash_dedup.op8_minhash_near_dedup,
    "op9_substring_dedup": passages.op9_substring_dedup,
    "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
}
ORACLE_SQL: dict[str, str] = {"op7_chat_formatting": chat.ORACLE_SQL}
