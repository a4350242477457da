"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from curatrix.llm import decontaminate, dual_tree, kmeans_tree, language_id, line_dedup, mixing, mtree, near_dedup, quality, sharding, spelling, suffix_dedup, token_store

QUERIES = {
    "op1_mtree_top_k": mtree.query,
    "op2_line_dedup": line_dedup.query,
    "op3_language_id": language_id.query,
    "op4_decontaminate": decontaminate.query,
    "op5_mixing": mixing.query,
    "op6_sharding": sharding.query,
    "op7_near_dedup": near_dedup.query,
    "op8_token_store": token_store.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_quality": quality.query,
    "op11_lexical_search": dual_tree.query,
    "op12_spelling_variants": spelling.query,
    "op13_kmeans_tree_search": kmeans_tree.query,
}

ORACLES = {
    "op1_mtree_top_k": mtree.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op11_lexical_search": dual_tree.ORACLE,
}
