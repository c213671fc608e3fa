"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, html_extract, jaccard_join, line_dedup, media, packing, secrets, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_packing": packing.op6_packing,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_media_columns": media.op10_media_columns,
}

ORACLE_SQL = {"op2_exact_dedup": exact_dedup.GROUPS_SQL}
