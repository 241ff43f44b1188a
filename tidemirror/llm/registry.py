"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, html_extract, jaccard_join, langid, license_scan, minhash_join, periodic_runs, pivot_search, quality_mil, sharding, sp_codec, suffix_dedup, vector_codes

QUERIES = {
    "op2_pivot_topk": pivot_search.op2_pivot_topk,
    "op1_html_extract": html_extract.op1_html_extract,
    "op3_quality_mil": quality_mil.op3_quality_mil,
    "op4_language_id": langid.op4_language_id,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_spaced_seeds": decontaminate.op6_spaced_seeds,
    "op7_jaccard_rtree": jaccard_join.op7_jaccard_rtree,
    "op8_rendezvous_shards": sharding.op8_rendezvous_shards,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_sentencepiece_codec": sp_codec.op10_sentencepiece_codec,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_minhash_join": minhash_join.op12_minhash_join,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op1_html_extract": html_extract.ORACLE_OP1,
    "op2_pivot_topk": pivot_search.ORACLE_OP2,
    "op5_suffix_dedup": suffix_dedup.ORACLE_OP5,
    "op6_spaced_seeds": decontaminate.ORACLE_OP6,
    "op7_jaccard_rtree": jaccard_join.ORACLE_OP7,
    "op8_rendezvous_shards": sharding.ORACLE_OP8,
    "op9_license_scan": license_scan.ORACLE_OP9,
    "op11_vector_codes": vector_codes.ORACLE_OP11,
    "op12_minhash_join": minhash_join.ORACLE_OP12,
}
