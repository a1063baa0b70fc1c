"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from vectaria.llm import bpe, decontaminate, langid, pii, qda, repetition, secrets, setsketch, tokencount, urltree

QUERIES = {
    "op1_setsketch_near_dedup": setsketch.op1,
    "op2_suffix_repetition": repetition.op2,
    "op3_edit_aware_counts": tokencount.op3,
    "op4_boosted_pii": pii.op4,
    "op5_quadratic_discriminant": qda.op5,
    "op6_url_template_tree": urltree.op6,
    "op7_qgram_decontamination": decontaminate.op7,
    "op8_script_viterbi": langid.op8,
    "op9_bpe_rank_queue": bpe.op9,
    "op10_trigram_secrets": secrets.op10,
}
ORACLE_SQL = {
    "op1_setsketch_near_dedup": setsketch.OP1_SQL,
    "op2_suffix_repetition": repetition.OP2_SQL,
    "op6_url_template_tree": urltree.OP6_SQL,
}
