"""The queries of the training-data operators, and their SQL where it can express them."""

from . import ann, chat_format, jaccard_join, line_dedup, mixing, pii, quality_classifier, quality_rules, sentence_pieces, sharding

QUERIES = {
    "op1_anisotropic_ann": ann.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_vector_bin_packing": sharding.query,
    "op4_ngram_jaccard_join": jaccard_join.query,
    "op5_sentence_pieces": sentence_pieces.query,
    "op6_quality_rules": quality_rules.query,
    "op7_source_mixing": mixing.query,
    "op8_line_dedup": line_dedup.query,
    "op9_chat_format": chat_format.query,
    "op10_contextual_pii": pii.query,
}

ORACLE_SQL = {
    "op4_ngram_jaccard_join": jaccard_join.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op9_chat_format": chat_format.SQL,
}
