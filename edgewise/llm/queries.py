"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, embeddings, html, mixing, ordermin, pii, ppm, quality, simhash, substring

QUERIES = {
    "op1_nearest_url": html.op1,
    "op2_surrogates": pii.op2,
    "op3_source_mixing": mixing.op3,
    "op4_grid_order": embeddings.op4,
    "op5_quality_ranking": quality.op5,
    "op6_substring_log": substring.op6,
    "op7_simhash_pivots": simhash.op7,
    "op8_bpe_prefixes": bpe.op8,
    "op9_ppm": ppm.op9,
    "op10_order_minhash": ordermin.op10,
}

ORACLE_SQL = {
    "op3_source_mixing": mixing.OP3_SQL,
}
