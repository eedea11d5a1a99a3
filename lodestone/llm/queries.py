"""The registered queries of the training-data operators and, where SQL can express one, its SQL."""

from . import bpe, decontam, langid, linededup, lmscore, media, merkle, mixing, periods, simhash, suffixdedup, tokenids, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1,
    "op2_mixing": mixing.op2,
    "op3_media_avi": media.op3,
    "op4_toxicity_nbsvm": toxicity.op4,
    "op5_decontamination": decontam.op5,
    "op6_token_ids_rans": tokenids.op6,
    "op7_suffix_dedup": suffixdedup.op7,
    "op8_simhash_covering": simhash.op8,
    "op9_lm_scoring": lmscore.op9,
    "op10_language_id": langid.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_byte_bpe": bpe.op12,
    "op13_periodic_runs": periods.op13,
}

ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
}
