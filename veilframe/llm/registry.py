"""Queries and oracles of the training-data operators."""

from . import queries_op1, queries_op2, queries_op3, queries_op4, queries_op5, queries_op6, queries_op7, queries_op8, queries_op9, queries_op10

QUERIES = {
    "op1_substring_dedup": queries_op1.op1_substring_dedup,
    "op2_brown_lm": queries_op2.op2_brown_lm,
    "op3_minhash_near_dedup": queries_op3.op3_minhash_near_dedup,
    "op4_block_naming": queries_op4.op4_block_naming,
    "op5_toxicity": queries_op5.op5_toxicity,
    "op6_bpe": queries_op6.op6_bpe,
    "op7_language_id": queries_op7.op7_language_id,
    "op8_url_reputation": queries_op8.op8_url_reputation,
    "op9_template_decontamination": queries_op9.op9_template_decontamination,
    "op10_line_dedup": queries_op10.op10_line_dedup,
}
ORACLES = {
    "op1_substring_dedup": queries_op1.ORACLE,
    "op3_minhash_near_dedup": queries_op3.ORACLE,
    "op4_block_naming": queries_op4.ORACLE,
    "op8_url_reputation": queries_op8.ORACLE,
    "op10_line_dedup": queries_op10.ORACLE,
}
