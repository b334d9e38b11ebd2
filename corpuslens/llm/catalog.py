"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, line_dedup, ngram_join, packing, quality, substring_dedup, suffix_dedup, token_output, url_filter

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_token_output": token_output.op2_token_output,
    "op3_packing": packing.op3_packing,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_chat_formatting": chat.op10_chat_formatting,
}
ORACLES = {
    "op7_decontamination": decontaminate.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
}
