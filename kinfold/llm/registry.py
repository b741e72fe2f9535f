"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from kinfold.llm import byte_bpe, exact_dedup, line_dedup, packing, pii, progressive_jpeg, quality_fm, simhash, substring_dedup, window_dedup

QUERIES = {
    "op1_progressive_jpeg": progressive_jpeg.op1,
    "op2_quality_fm": quality_fm.op2,
    "op3_min_bin_slack": packing.op3,
    "op4_deletion_neighbourhood": line_dedup.op4,
    "op5_simhash": simhash.op5,
    "op6_prefix_free_parsing": substring_dedup.op6,
    "op7_byte_bpe": byte_bpe.op7,
    "op8_level_doubling": window_dedup.op8,
    "op9_weak_pii": pii.op9,
    "op10_exact_dedup": exact_dedup.op10,
}
ORACLES = {
    "op8_level_doubling": window_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
