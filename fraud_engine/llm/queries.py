"""Registered queries of the subpackage, and their SQL twins."""

from __future__ import annotations

from fraud_engine.llm.alignment import op11_diagonal_align
from fraud_engine.llm.decontaminate import op10_decontaminate
from fraud_engine.llm.fingerprint import op3_fingerprint
from fraud_engine.llm.jaccard_join import op6_jaccard
from fraud_engine.llm.language import op5_language
from fraud_engine.llm.lexical_search import op12_mask_search
from fraud_engine.llm.line_dedup import op9_line_dedup
from fraud_engine.llm.mixing import op13_pareto_mix
from fraud_engine.llm.oracle import ORACLE  # noqa: F401
from fraud_engine.llm.packing import op8_best_fit
from fraud_engine.llm.ppm import op7_ppm
from fraud_engine.llm.suffix_dedup import op1_suffix_dedup
from fraud_engine.llm.tokens import op4_token_planes
from fraud_engine.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprint": op3_fingerprint,
    "op4_token_planes": op4_token_planes,
    "op5_language": op5_language,
    "op6_jaccard": op6_jaccard,
    "op7_ppm": op7_ppm,
    "op8_best_fit": op8_best_fit,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_diagonal_align": op11_diagonal_align,
    "op12_mask_search": op12_mask_search,
    "op13_pareto_mix": op13_pareto_mix,
}
