"""Registry of the training-data operators' queries."""

from __future__ import annotations

from ridgeline.llm import chat_format, chunk_dedup, embedding_dedup, html_layout, language_id, license_scan, mixing, packing, simhash, weak_quality


def queries():
    return {
        "op1_entropy_mix": mixing.query,
        "op2_cross_parsing": language_id.query,
        "op3_reply_trees": chat_format.query,
        "op4_anchor_simhash": simhash.query,
        "op5_weak_label_quality": weak_quality.query,
        "op6_vector_best_fit": packing.query,
        "op7_chunk_recipes": chunk_dedup.query,
        "op8_layout_text": html_layout.query,
        "op9_canonical_licenses": license_scan.query,
        "op10_sign_hashing": embedding_dedup.query,
    }


def oracle_sql():
    """The others are tested against brute force, round trips or held-out rows: SQL has no counterpart of them."""
    return {
        "op3_reply_trees": chat_format.SQL,
        "op7_chunk_recipes": chunk_dedup.SQL,
        "op9_canonical_licenses": license_scan.SQL,
        "op10_sign_hashing": embedding_dedup.SQL,
    }
