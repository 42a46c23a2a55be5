"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from synframe.llm import decontaminate, negatives, quality_rules, suffix_dedup, topk, url_filter
from synframe.llm.language_id import op4_language_id
from synframe.llm.line_dedup import op7_line_dedup
from synframe.llm.mixing import op5_mix_sources
from synframe.llm.packing import op2_pack
from synframe.llm.periodic import op12_periodic_runs
from synframe.llm.quality_classifier import op3_quality_classifier
from synframe.llm.quality_rules import op9_quality_rules
from synframe.llm.simhash import op8_simhash_neardup
from synframe.llm.suffix_dedup import op1_suffix_dedup
from synframe.llm.topk import op10_topk

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pack": op2_pack,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_mix_sources": op5_mix_sources,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash_neardup": op8_simhash_neardup,
    "op9_quality_rules": op9_quality_rules,
    "op10_topk": op10_topk,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op10_topk": topk.ORACLE_SQL,
    "op11_hard_negatives": negatives.ORACLE_SQL,
    "op13_decontaminate": decontaminate.ORACLE_SQL,
}
