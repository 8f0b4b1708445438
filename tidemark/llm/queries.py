"""The registered queries of this folder, with SQL where SQL can say the same."""

from . import alignment, decontamination, hard_negatives, language_id, licenses, ngram_join, packing, permutation_index, pii, secrets, toxicity, vector_search, warc

QUERIES = {
    "op1_decontaminate": (decontamination.op1, decontamination.SQL),
    "op2_ngram_join": (ngram_join.op2, None),
    "op3_language_id": (language_id.op3, None),
    "op4_secret_links": (secrets.op4, None),
    "op5_warc_bundles": (warc.op5, warc.SQL),
    "op6_toxicity": (toxicity.op6, None),
    "op7_best_two_fit": (packing.op7, None),
    "op8_license_scan": (licenses.op8, None),
    "op9_exact_top_k": (vector_search.op9, vector_search.SQL),
    "op10_pii_surrogates": (pii.op10, None),
    "op11_token_alignment": (alignment.op11, None),
    "op12_permutation_index": (permutation_index.op12, None),
    "op13_hard_negatives": (hard_negatives.op13, hard_negatives.SQL),
}
