"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import collocations, cotraining, decontaminate, jaccard_join, language_id, lexical_search, ngram_lm, pieces, pii, quality_rules, token_counts, toxicity, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_cotraining": cotraining.op3_cotraining,
    "op4_lm_scoring": ngram_lm.op4_lm_scoring,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_language_id": language_id.op7_language_id,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_collocations": collocations.op12_collocations,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLES = {"op10_url_filters": url_filter.ORACLE, "op12_collocations": collocations.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
