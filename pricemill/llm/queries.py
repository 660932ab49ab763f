"""The training-data queries and, where SQL can say them, their SQL twins."""

from __future__ import annotations

from . import cells, codebooks, fingerprints, jaccard_join, language, lm_score, mixing, pieces, polytope, quality, secret_scan, sharding, substrings

QUERIES = {
    "op1_source_mix": mixing.op1,
    "op2_jaccard_join": jaccard_join.op2,
    "op3_fingerprints": fingerprints.op3,
    "op4_sampled_pieces": pieces.op4,
    "op5_lattice_scores": lm_score.op5,
    "op6_weak_quality": quality.op6,
    "op7_cover_dedup": substrings.op7,
    "op8_secret_scan": secret_scan.op8,
    "op9_language_id": language.op9,
    "op10_jump_shards": sharding.op10,
    "op11_va_clusters": cells.op11,
    "op12_polytope_dedup": polytope.op12,
    "op13_bounded_codes": codebooks.op13,
}

ORACLES = {
    "op1_source_mix": mixing.OP1_SQL,
    "op2_jaccard_join": jaccard_join.OP2_SQL,
    "op7_cover_dedup": substrings.OP7_SQL,
    "op10_jump_shards": sharding.OP10_SQL,
    "op11_va_clusters": cells.OP11_SQL,
    "op12_polytope_dedup": polytope.OP12_SQL,
    "op13_bounded_codes": codebooks.OP13_SQL,
}
