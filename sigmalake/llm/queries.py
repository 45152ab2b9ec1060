"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import codes, embeddings, language, licenses, mixing, packing, private, quality, ranked, scoring, simhash, substrings, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_pack": packing.op2_pack,
    "op3_lm_scores": scoring.op3_lm_scores,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language": language.op7_language,
    "op8_substrings": substrings.op8_substrings,
    "op9_simhash": simhash.op9_simhash,
    "op10_licenses": licenses.op10_licenses,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_personal_data": private.op12_personal_data,
    "op13_ranked_search": ranked.op13_ranked_search,
}

ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op8_substrings": substrings.OP8_SQL,
    "op11_vector_codes": codes.OP11_SQL,
    "op13_ranked_search": ranked.OP13_SQL,
}
