"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from tessera.llm import decontamination, licenses, linkgraph, mixing, quality, scoring, sharding, similarity, substrings, topk

QUERIES = {
    "op1_similarity": similarity.op1_similarity,
    "op2_topk": topk.op2_topk,
    "op3_sharding": sharding.op3_sharding,
    "op4_mixing": mixing.op4_mixing,
    "op5_licenses": licenses.op5_licenses,
    "op6_substrings": substrings.op6_substrings,
    "op7_quality": quality.op7_quality,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_linkgraph": linkgraph.op9_linkgraph,
    "op10_lm_scoring": scoring.op10_lm_scoring,
}

SQL = {
    "op1_similarity": similarity.OP1_SQL,
    "op2_topk": topk.OP2_SQL,
    "op3_sharding": sharding.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
}
