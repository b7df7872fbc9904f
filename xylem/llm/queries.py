"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import fingerprints, language_id, lm_scoring, mixing, neighbours, sentencepiece, simhash, suffix_dedup, token_counts, toxicity


def queries():
    return {
        "op1_language_id": language_id.op1,
        "op2_fingerprints": fingerprints.op2,
        "op3_suffix_dedup": suffix_dedup.op3,
        "op4_token_counts": token_counts.op4,
        "op5_neighbours": neighbours.op5,
        "op6_lm_scoring": lm_scoring.op6,
        "op7_toxicity": toxicity.op7,
        "op8_sentencepiece": sentencepiece.op8,
        "op9_simhash": simhash.op9,
        "op10_mixing": mixing.op10,
    }


def oracle_sql():
    return {"op3_suffix_dedup": suffix_dedup.OP3_SQL, "op10_mixing": mixing.OP10_SQL}
