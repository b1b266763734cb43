"""Queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from provgraph.llm import decontaminate, gif, license_scan, mixing, ngram_join, suffix_tree, token_counts, token_files, toxicity, url_filter

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_media_columns": gif.op2,
    "op3_token_counts": token_counts.op3,
    "op4_toxicity": toxicity.op4,
    "op5_url_filters": url_filter.op5,
    "op6_token_files": token_files.op6,
    "op7_lm_scoring": suffix_tree.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_license_scans": license_scan.op9,
    "op10_mixing": mixing.op10,
}

ORACLE_SQL = {"op5_url_filters": url_filter.ORACLE_SQL, "op8_decontamination": decontaminate.ORACLE_SQL}
