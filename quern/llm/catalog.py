"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, exact_dedup, html_main, license_scan, media, mixing, secret_scan, shingle_join, token_store, toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_ngram_jaccard_join": shingle_join.op2_ngram_jaccard_join,
        "op3_media": media.op3_media,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_main_text": html_main.op6_main_text,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_token_store": token_store.op8_token_store,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_bpe": bpe.op10_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
