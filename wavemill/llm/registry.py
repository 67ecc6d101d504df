"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import fingerprints, interleaved, language_id, minhash_dedup, mixing, ordered_packing, packing, periodic_runs, spelling_variants, substring_dedup, token_output, tool_calls, toxicity

QUERIES = {
    "op1_tool_calls": tool_calls.op1_tool_calls,
    "op2_language_id": language_id.op2_language_id,
    "op3_token_output": token_output.op3_token_output,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_minhash_near_dedup": minhash_dedup.op6_minhash_near_dedup,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_interleaved": interleaved.op9_interleaved,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_ordered_packing": ordered_packing.op13_ordered_packing,
}

ORACLE_SQL = {"op1_tool_calls": tool_calls.OP1_SQL, "op4_mixing": mixing.OP4_SQL}
