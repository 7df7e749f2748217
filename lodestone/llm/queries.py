"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lodestone.llm import byte_pairs, code_switch, html_lines, lsh_forest, mixing, quality, secret_forest, sharding, spaced_seeds, target_resampling, threshold_topk, token_counts, window_ranks

QUERIES = {
    "op1_code_switch_language": code_switch.op1,
    "op2_secret_forest": secret_forest.op2,
    "op3_stratified_interleave": sharding.op3,
    "op4_line_block_text": html_lines.op4,
    "op5_threshold_topk": threshold_topk.op5,
    "op6_spaced_seed_decontamination": spaced_seeds.op6,
    "op7_mix_to_weights": mixing.op7,
    "op8_lsh_forest": lsh_forest.op8,
    "op9_prefix_token_counts": token_counts.op9,
    "op10_random_indexing_quality": quality.op10,
    "op11_persistent_tree_windows": window_ranks.op11,
    "op12_prefix_byte_pairs": byte_pairs.op12,
    "op13_target_resampling": target_resampling.op13,
}

ORACLES = {
    "op5_threshold_topk": threshold_topk.OP5_SQL,
    "op6_spaced_seed_decontamination": spaced_seeds.oracle_sql(),
    "op7_mix_to_weights": mixing.OP7_SQL,
    "op11_persistent_tree_windows": window_ranks.OP11_SQL,
    "op13_target_resampling": target_resampling.OP13_SQL,
}
