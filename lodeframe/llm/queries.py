"""The driver queries of the corpus operators, with SQL for those that SQL can express."""

from . import chat, exact_dedup, fingerprints, hard_negatives, mixing, packing, periodic, pii, quality, simhash, token_counts, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_quality": quality.op5_quality,
    "op6_pii": pii.op6_pii,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_packing": packing.op8_packing,
    "op9_simhash": simhash.op9_simhash,
    "op10_chat_format": chat.op10_chat_format,
    "op11_warc": warc.op11_warc,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op11_warc": warc.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
