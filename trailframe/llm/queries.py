"""The operators' queries and their DuckDB SQL, for the entry module."""

from __future__ import annotations

from trailframe.llm import bpe, chat_format, decontamination, exact_topk, hard_negatives, language_id, line_dedup, near_dedup, quality, secrets, spelling, suffix_dedup, token_files

QUERIES = {
    "op1_topk": exact_topk.op1_topk,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_quality": quality.op3_quality,
    "op4_language_id": language_id.op4_language_id,
    "op5_bpe": bpe.op5_bpe,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_token_files": token_files.op9_token_files,
    "op10_secrets": secrets.op10_secrets,
    "op11_spelling": spelling.op11_spelling,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
SQL = {
    "op1_topk": exact_topk.SQL,
    "op2_chat_format": chat_format.SQL,
    "op6_near_dedup": near_dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_decontamination": decontamination.SQL,
    "op10_secrets": secrets.SQL,
    "op11_spelling": spelling.SQL,
    "op12_suffix_dedup": suffix_dedup.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
