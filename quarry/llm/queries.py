"""The registered queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

from quarry.llm import byte_cnn, chat_format, clustering, decontaminate, hard_negatives, html_extract, line_dedup, packing, personal_data, quality_rules, simhash, suffix_dedup, training_order

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_training_order": training_order.op4_training_order,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_quality_classifier": byte_cnn.op9_quality_classifier,
    "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_centroid_clustering": clustering.op12_centroid_clustering,
    "op13_pii": personal_data.op13_pii,
}

ORACLE_SQL = {
    "op2_chat_format": chat_format.ORACLE_OP2,
    "op3_decontamination": decontaminate.ORACLE_OP3,
    "op7_line_dedup": line_dedup.ORACLE_OP7,
    "op11_hard_negatives": hard_negatives.ORACLE_OP11,
    "op12_centroid_clustering": clustering.ORACLE_OP12,
}
