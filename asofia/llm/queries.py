"""Registered queries of this folder: name -> (builder, oracle SQL or None)."""

from __future__ import annotations

from asofia.llm import (blob_ledger, dialogue_repair, dual_tree_search, grammar, language_mixture, merge_replay, near_dedup, packing, passage_attention, quality_rules, recurrent_toxicity, tool_links,
                        topk_bounds)

QUERIES = {
    "op1_passage_attention": (passage_attention.op1_passage_attention, None),
    "op2_topk_bounds": (topk_bounds.op2_topk_bounds, topk_bounds.OP2_SQL),
    "op3_recurrent_toxicity": (recurrent_toxicity.op3_recurrent_toxicity, None),
    "op4_quality_rules": (quality_rules.op4_quality_rules, None),
    "op5_grammar": (grammar.op5_grammar, None),
    "op6_packing": (packing.op6_packing, None),
    "op7_near_dedup": (near_dedup.op7_near_dedup, None),
    "op8_merge_replay": (merge_replay.op8_merge_replay, None),
    "op9_tool_links": (tool_links.op9_tool_links, tool_links.OP9_SQL),
    "op10_blob_ledger": (blob_ledger.op10_blob_ledger, None),
    "op11_language_mixture": (language_mixture.op11_language_mixture, None),
    "op12_dual_tree_search": (dual_tree_search.op12_dual_tree_search, dual_tree_search.OP12_SQL),
    "op13_dialogue_repair": (dialogue_repair.op13_dialogue_repair, dialogue_repair.OP13_SQL),
}
