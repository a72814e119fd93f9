"""Names under which the queries of this subpackage are registered."""

from __future__ import annotations

from . import oracle, queries

QUERIES = {
    "op1_packing": queries.op1_packing,
    "op2_quality": queries.op2_quality,
    "op3_top_k": queries.op3_top_k,
    "op4_toxicity": queries.op4_toxicity,
    "op5_substring_dedup": queries.op5_substring_dedup,
    "op6_fingerprints": queries.op6_fingerprints,
    "op7_secrets": queries.op7_secrets,
    "op8_mixing": queries.op8_mixing,
    "op9_token_counts": queries.op9_token_counts,
    "op10_jaccard_join": queries.op10_jaccard_join,
    "op11_byte_bpe": queries.op11_byte_bpe,
    "op12_merkle": queries.op12_merkle,
    "op13_whitening": queries.op13_whitening,
}
ORACLE_SQL = {
    "op3_top_k": oracle.OP3_TOP_K,
    "op5_substring_dedup": oracle.OP5_SUBSTRING_DEDUP,
    "op8_mixing": oracle.OP8_MIXING,
    "op10_jaccard_join": oracle.OP10_JACCARD_JOIN,
    "op12_merkle": oracle.OP12_MERKLE,
}
