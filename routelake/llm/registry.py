"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import chaining, counts, jaccard, mixing, neighbours, packing, quality, suffixes, warc, wavelet

QUERIES = {
    "op1_ann": neighbours.op1_ann,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_wavelet_tokens": wavelet.op4_wavelet_tokens,
    "op5_warc": warc.op5_warc,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_substring_dedup": chaining.op7_substring_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_token_counts": counts.op9_token_counts,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
}
ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_suffix_dedup": suffixes.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op10_jaccard_join": jaccard.ORACLE,
}
