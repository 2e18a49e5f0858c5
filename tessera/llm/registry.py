"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import codes, exact_dedup, hilbert, language, mixing, packing, pieces, pitman_yor, quality, simhash, surrogates, token_store, variants


def queries():
    return {
        "op1_hilbert_shards": hilbert.op1_hilbert_shards,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_pitman_yor": pitman_yor.op3_pitman_yor,
        "op4_language": language.op4_language,
        "op5_simhash": simhash.op5_simhash,
        "op6_token_store": token_store.op6_token_store,
        "op7_decision_list": quality.op7_decision_list,
        "op8_mix_to_weights": mixing.op8_mix_to_weights,
        "op9_surrogates": surrogates.op9_surrogates,
        "op10_pieces": pieces.op10_pieces,
        "op11_spelling_variants": variants.op11_spelling_variants,
        "op12_cost_balanced_packing": packing.op12_cost_balanced_packing,
        "op13_vector_codes": codes.op13_vector_codes,
    }


def oracle_sql():
    return {"op2_exact_dedup": exact_dedup.OP2_SQL, "op8_mix_to_weights": mixing.OP8_SQL, "op11_spelling_variants": variants.OP11_SQL, "op13_vector_codes": codes.OP13_SQL}
