"""Queries of the training-data operators, one per operator, and their DuckDB twins."""

from __future__ import annotations

from leakloom.llm import (
    license_scan, line_spread, middle_fill, mixing, parity_join, positional_index, quality, shard_propagation, token_records,
    toxicity, trie_dedup, url_cascade, whitening,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_url_cascade": url_cascade.op2_url_cascade,
    "op3_parity_join": parity_join.op3_parity_join,
    "op4_shard_propagation": shard_propagation.op4_shard_propagation,
    "op5_token_records": token_records.op5_token_records,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_spread": line_spread.op7_line_spread,
    "op8_trie_dedup": trie_dedup.op8_trie_dedup,
    "op9_positional_index": positional_index.op9_positional_index,
    "op10_mix": mixing.op10_mix,
    "op11_middle_fill": middle_fill.op11_middle_fill,
    "op12_quadratic_quality": quality.op12_quadratic_quality,
    "op13_refined_whitening": whitening.op13_refined_whitening,
}
ORACLES = {
    "op2_url_cascade": url_cascade.OP2_SQL,
    "op7_line_spread": line_spread.OP7_SQL,
    "op8_trie_dedup": trie_dedup.OP8_SQL,
    "op9_positional_index": positional_index.OP9_SQL,
    "op10_mix": mixing.OP10_SQL,
    "op11_middle_fill": middle_fill.OP11_SQL,
}
