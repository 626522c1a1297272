"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import html, licences, linededup, mixing, pieces, quality, sharding, simhash, substrings, topk

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_simhash_dedup": simhash.op2_simhash_dedup,
    "op3_html_extract": html.op3_html_extract,
    "op4_license_scan": licences.op4_license_scan,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_shard_shuffle": sharding.op7_shard_shuffle,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_mix_sources": mixing.op10_mix_sources,
}

SQL = {
    "op4_license_scan": licences.OP4_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op6_exact_topk": topk.OP6_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op9_substring_dedup": substrings.OP9_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
}
