"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from flowloom.llm.decontaminate import op6_decontamination
from flowloom.llm.html_extract import op2_html_extraction
from flowloom.llm.line_dedup import op5_line_dedup
from flowloom.llm.near_dedup import op8_minhash_near_dedup
from flowloom.llm.packing import op3_best_fit_packing
from flowloom.llm.pii import op10_pii
from flowloom.llm.quality import op4_quality_rules
from flowloom.llm.suffix_dedup import op1_suffix_array_dedup
from flowloom.llm.toxicity import op9_toxicity
from flowloom.llm.warc import op7_warc

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
}

ORACLE: dict[str, str] = {}
