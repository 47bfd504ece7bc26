"""The corpus operators as queries on the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import op1_license, op2_mix, op3_tokens, op4_sentencepiece, op5_chat, op6_exact, op7_urls, op8_ann, op9_neardup, op10_toxicity, op11_codes, op12_ngram_join, op13_merkle

QUERIES = {
    f.__name__: f
    for f in (
        op1_license.op1_license_scan,
        op2_mix.op2_source_mix,
        op3_tokens.op3_token_counts,
        op4_sentencepiece.op4_sentencepiece,
        op5_chat.op5_chat_format,
        op6_exact.op6_exact_dedup,
        op7_urls.op7_url_filter,
        op8_ann.op8_ann_search,
        op9_neardup.op9_near_duplicates,
        op10_toxicity.op10_toxicity,
        op11_codes.op11_vector_codes,
        op12_ngram_join.op12_ngram_join,
        op13_merkle.op13_merkle_manifest,
    )
}
ORACLE_SQL = {
    "op1_license_scan": op1_license.ORACLE,
    "op2_source_mix": op2_mix.ORACLE,
    "op5_chat_format": op5_chat.ORACLE,
    "op6_exact_dedup": op6_exact.ORACLE,
    "op8_ann_search": op8_ann.ORACLE,
    "op9_near_duplicates": op9_neardup.ORACLE,
    "op11_vector_codes": op11_codes.ORACLE,
    "op12_ngram_join": op12_ngram_join.ORACLE,
    "op13_merkle_manifest": op13_merkle.ORACLE,
}
