"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from .alignment import op12_alignment
from .html import op2_html
from .jaccard import OP3_SQL, op3_jaccard
from .language import op10_language
from .mixing import op5_mixing
from .packing import op6_packing
from .quality import op1_quality
from .rules import OP7_SQL, op7_rules
from .runs import op13_runs
from .spotsigs import op4_spotsigs
from .topk import OP11_SQL, op11_topk
from .urls import OP8_SQL, op8_urls
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_jaccard": op3_jaccard,
    "op4_spotsigs": op4_spotsigs,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_rules": op7_rules,
    "op8_urls": op8_urls,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_topk": op11_topk,
    "op12_alignment": op12_alignment,
    "op13_runs": op13_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": OP3_SQL,
    "op7_rules": OP7_SQL,
    "op8_urls": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op11_topk": OP11_SQL,
}
