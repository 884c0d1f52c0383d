"""Registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import (chat_template, collision_ann, decontaminate, lm_score, merkle, mixing, order_minhash, quality_gam, ranked_search,
               secret_scan, sharding, token_counts, toxicity)

QUERIES = {
    "op1_order_minhash": order_minhash.query,
    "op2_cross_entropy_difference": lm_score.query,
    "op3_minimax_shards": sharding.query,
    "op4_toxicity": toxicity.query,
    "op5_chat_template": chat_template.query,
    "op6_secret_scan": secret_scan.query,
    "op7_mixing": mixing.query,
    "op8_decontaminate": decontaminate.query,
    "op9_quality_gam": quality_gam.query,
    "op10_collision_ann": collision_ann.query,
    "op11_ranked_search": ranked_search.query,
    "op12_merkle_manifest": merkle.query,
    "op13_token_counts": token_counts.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {"op5_chat_template": chat_template.ORACLE, "op8_decontaminate": decontaminate.ORACLE, "op11_ranked_search": ranked_search.ORACLE,
          "op12_merkle_manifest": merkle.ORACLE}
