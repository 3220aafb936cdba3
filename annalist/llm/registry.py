"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import class_lm, fingerprints, html_text, line_dedup, mixing, near_dedup, packing, quality, topk, url_filter

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_class_lm": class_lm.op2_class_lm,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_packing": packing.op5_packing,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_html": html_text.op10_html,
}

SQL = {"op1_topk": topk.SQL}
