"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from quire.llm import bilinear, chat_tree, decision_list, decontaminate, jaccard_join, language_id, mixing, personal_data, revisits, training_order


def queries() -> dict:
    return {
        "op1_lm_scoring": bilinear.op1_lm_scoring,
        "op2_revisits": revisits.op2_revisits,
        "op3_language_id": language_id.op3_language_id,
        "op4_training_order": training_order.op4_training_order,
        "op5_quality_rules": decision_list.op5_quality_rules,
        "op6_personal_data": personal_data.op6_personal_data,
        "op7_mixing": mixing.op7_mixing,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_chat_tree": chat_tree.op9_chat_tree,
        "op10_decontamination": decontaminate.op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_revisits": revisits.ORACLE, "op7_mixing": mixing.ORACLE, "op9_chat_tree": chat_tree.ORACLE}
