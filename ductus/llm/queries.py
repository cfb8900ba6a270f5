"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from ductus.llm import html_text, katz, line_dedup, media, mixing, packing, quality, sharding, simhash, toxicity

QUERIES = {
    "op1_block_text": html_text.op1_block_text,
    "op2_simhash_anchors": simhash.op2_simhash_anchors,
    "op3_host_quality": quality.op3_host_quality,
    "op4_katz_backoff": katz.op4_katz_backoff,
    "op5_stratified_shards": sharding.op5_stratified_shards,
    "op6_hash_threshold_mix": mixing.op6_hash_threshold_mix,
    "op7_vector_best_fit": packing.op7_vector_best_fit,
    "op8_transport_streams": media.op8_transport_streams,
    "op9_line_windows": line_dedup.op9_line_windows,
    "op10_pattern_grammar": toxicity.op10_pattern_grammar,
}

ORACLES = {
    "op3_host_quality": quality.ORACLE,
    "op6_hash_threshold_mix": mixing.ORACLE,
}
