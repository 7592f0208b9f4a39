"""Registered queries of this subpackage and their DuckDB checks."""

from __future__ import annotations

from outagekit.llm import (
    bpe_dropout, collocations, exact_dedup, line_chunks, mixing, pfp, secret_scan, sharding, simhash, spelling, topk,
    toxicity, url_reputation,
)

QUERIES = {
    "op1_cube_mix": mixing.op1_cube_mix,
    "op2_pfp_repeats": pfp.op2_pfp_repeats,
    "op3_bpe_dropout": bpe_dropout.op3_bpe_dropout,
    "op4_nra_topk": topk.op4_nra_topk,
    "op5_url_reputation": url_reputation.op5_url_reputation,
    "op6_secret_forest": secret_scan.op6_secret_forest,
    "op7_simhash_vp": simhash.op7_simhash_vp,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_line_dedup": line_chunks.op9_line_dedup,
    "op10_toxicity_cnn": toxicity.op10_toxicity_cnn,
    "op11_external_shuffle": sharding.op11_external_shuffle,
    "op12_stripes": collocations.op12_stripes,
    "op13_pivotal_grams": spelling.op13_pivotal_grams,
}
ORACLES = {
    "op4_nra_topk": topk.OP4_SQL,
    "op5_url_reputation": url_reputation.OP5_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_line_dedup": line_chunks.OP9_SQL,
    "op12_stripes": collocations.OP12_SQL,
}
