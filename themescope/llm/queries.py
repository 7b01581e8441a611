"""Registered queries of the subpackage: name -> builder, name -> DuckDB SQL."""

from __future__ import annotations

from themescope.llm import chat, covertree, grammar, langid, minhash, mixing, packing, passages, quality, repair, runs, sharding, topk

QUERIES = {
    "op1_external_shuffle": sharding.query,
    "op2_grammar_tokens": grammar.query,
    "op3_cross_parsing": langid.query,
    "op4_weighted_minhash": minhash.query,
    "op5_norm_sorted_search": topk.query,
    "op6_cover_tree": covertree.query,
    "op7_level_packing": packing.query,
    "op8_source_schedule": mixing.query,
    "op9_importance_resampling": quality.query,
    "op10_chat_format": chat.query,
    "op11_grammar_runs": runs.query,
    "op12_structure_repair": repair.query,
    "op13_run_length_index": passages.query,
}

ORACLE_SQL = {
    "op5_norm_sorted_search": topk.ORACLE,
    "op6_cover_tree": covertree.ORACLE,
    "op8_source_schedule": mixing.ORACLE,
    "op10_chat_format": chat.ORACLE,
}
