"""The queries of this package and their SQL."""

from __future__ import annotations

from loomwatch.llm import class_lm, embedding_dedup, filter_audit, licenses, mixing, neighbours, packing, quality, secrets, simhash, spelling, substring_dedup, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_packing": packing.op2_packing,
    "op3_mixing": mixing.op3_mixing,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_class_lm": class_lm.op6_class_lm,
    "op7_simhash": simhash.op7_simhash,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_quality": quality.op10_quality,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_license_scan": licenses.op12_license_scan,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op8_embedding_dedup": embedding_dedup.SQL,
    "op9_neighbours": neighbours.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_license_scan": licenses.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
