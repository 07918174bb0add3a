"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tessera.llm import bpe_tree, conversations, decontamination, jaccard_join, line_dedup, prefix_forest, quality, sharding, substring_dedup, token_files, toxicity, warc, whitening

QUERIES = {
    "op10_cgk_decontamination": decontamination.op10_cgk_decontamination,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op8_quality_llr": quality.op8_quality_llr,
    "op7_bpe_tree": bpe_tree.op7_bpe_tree,
    "op4_toxicity": toxicity.op4_toxicity,
    "op3_token_files": token_files.op3_token_files,
    "op6_warc_segments": warc.op6_warc_segments,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op9_kd_sharding": sharding.op9_kd_sharding,
    "op11_whitening": whitening.op11_whitening,
    "op12_prefix_forest": prefix_forest.op12_prefix_forest,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op6_warc_segments": warc.OP6_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
}
