"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import op1_license, op2_shards, op3_chat, op4_decontam, op5_urls, op6_tokens, op7_quality, op8_simhash, op9_lm, op10_bpe, op11_spelling, op12_runs, op13_topk

QUERIES = {
    "op1_license_scan": op1_license.op1_license_scan,
    "op2_sharding": op2_shards.op2_sharding,
    "op3_chat_format": op3_chat.op3_chat_format,
    "op4_decontamination": op4_decontam.op4_decontamination,
    "op5_url_filter": op5_urls.op5_url_filter,
    "op6_token_counts": op6_tokens.op6_token_counts,
    "op7_quality_rules": op7_quality.op7_quality_rules,
    "op8_simhash": op8_simhash.op8_simhash,
    "op9_lm_score": op9_lm.op9_lm_score,
    "op10_byte_bpe": op10_bpe.op10_byte_bpe,
    "op11_spelling_variants": op11_spelling.op11_spelling_variants,
    "op12_periodic_runs": op12_runs.op12_periodic_runs,
    "op13_exact_topk": op13_topk.op13_exact_topk,
}

ORACLES = {
    "op1_license_scan": op1_license.oracle(),
    "op2_sharding": op2_shards.oracle(),
    "op3_chat_format": op3_chat.oracle(),
    "op5_url_filter": op5_urls.oracle(),
    "op7_quality_rules": op7_quality.oracle(),
    "op11_spelling_variants": op11_spelling.oracle(),
    "op13_exact_topk": op13_topk.oracle(),
}
