"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import embeddings, exact_dedup, html_text, language_id, mixing, packing, pii, simhash, token_output, url_filter

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_packing": packing.op2_packing,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_simhash": simhash.op4_simhash,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_mixing": mixing.op6_mixing,
    "op7_embedding_dedup": embeddings.op7_embedding_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_pii": pii.op9_pii,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {"op10_exact_dedup": exact_dedup.SQL}
