"""Registered queries of this subpackage: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from . import ann, attribution, exactdup, language, manifest, mixing, neardup, packing, pii, quality, resample, topk, urlfilter

REGISTRY = {
    "op1_best_fit_packing": (packing.query, None),
    "op2_personal_data": (pii.query, None),
    "op3_language": (language.query, None),
    "op4_nearest_neighbours": (ann.query, None),
    "op5_exact_top_k": (topk.query, topk.SQL),
    "op6_near_duplicates": (neardup.query, neardup.SQL),
    "op7_token_counts": (attribution.query, None),
    "op8_source_mixing": (mixing.query, mixing.SQL),
    "op9_quality": (quality.query, None),
    "op10_url_rules": (urlfilter.query, urlfilter.SQL),
    "op11_exact_duplicates": (exactdup.query, exactdup.SQL),
    "op12_importance_resampling": (resample.query, resample.SQL),
    "op13_merkle_manifest": (manifest.query, manifest.SQL),
}
