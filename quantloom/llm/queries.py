"""Queries of the llm operators and, where SQL can express them, their SQL."""

from . import cover_tree, exact_dedup, fill_middle, licenses, mixing, ngram_join, periodic_runs, quality, rans, secrets, sentence_pieces, separators, telephony

QUERIES = {
    "op1_separator_token_counts": separators.op1_separator_token_counts,
    "op2_rans_token_file": rans.op2_rans_token_file,
    "op3_attention_mil_quality": quality.op3_attention_mil_quality,
    "op4_water_filling_mix": mixing.op4_water_filling_mix,
    "op5_lsm_exact_dedup": exact_dedup.op5_lsm_exact_dedup,
    "op6_forest_secret_scan": secrets.op6_forest_secret_scan,
    "op7_bayesian_jaccard_join": ngram_join.op7_bayesian_jaccard_join,
    "op8_viterbi_sentence_pieces": sentence_pieces.op8_viterbi_sentence_pieces,
    "op9_telephony_audio": telephony.op9_telephony_audio,
    "op10_rare_token_licenses": licenses.op10_rare_token_licenses,
    "op11_lyndon_array_runs": periodic_runs.op11_lyndon_array_runs,
    "op12_distinct_text_fill_middle": fill_middle.op12_distinct_text_fill_middle,
    "op13_cover_tree_embedding_dedup": cover_tree.op13_cover_tree_embedding_dedup,
}

ORACLE_SQL = {
    "op4_water_filling_mix": mixing.OP4_SQL,
    "op5_lsm_exact_dedup": exact_dedup.OP5_SQL,
    "op10_rare_token_licenses": licenses.OP10_SQL,
    "op12_distinct_text_fill_middle": fill_middle.OP12_SQL,
    "op13_cover_tree_embedding_dedup": cover_tree.OP13_SQL,
}
