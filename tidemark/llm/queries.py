"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import exact_dedup, fingerprint, lm_scoring, minhash, oracles, packing, recompression, secrets, sentencepiece, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_lm_scoring": lm_scoring.op4_lm_scoring,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_substring_dedup": recompression.op6_substring_dedup,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_sentencepiece": sentencepiece.op8_sentencepiece,
        "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
        "op10_fingerprint": fingerprint.op10_fingerprint,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLE)
