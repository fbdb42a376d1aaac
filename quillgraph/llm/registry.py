"""The queries of the numbered operators, and their SQL."""

from __future__ import annotations

from . import chunk_dedup, exact, huffman_ids, importance, license_scan, line_templates, packing, quality, sentencepiece_codec, shingle_join, token_count, warc, whitening


def queries() -> dict:
    return {
        "op1_token_counts": token_count.op1_token_counts,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_warc": warc.op3_warc,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_substring_dedup": chunk_dedup.op5_substring_dedup,
        "op6_jaccard_join": shingle_join.op6_jaccard_join,
        "op7_exact_dedup": exact.op7_exact_dedup,
        "op8_line_dedup": line_templates.op8_line_dedup,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_packing": packing.op10_packing,
        "op11_huffman_ids": huffman_ids.op11_huffman_ids,
        "op12_importance_resampling": importance.op12_importance_resampling,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict:
    return {"op3_warc": warc.OP3_SQL, "op7_exact_dedup": exact.OP7_SQL, "op8_line_dedup": line_templates.OP8_SQL, "op9_quality_rules": quality.OP9_SQL, "op12_importance_resampling": importance.OP12_SQL}
