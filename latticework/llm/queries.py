"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "op1_token_output": "tokens",
    "op2_language_codes": "langid",
    "op3_simhash": "simhash",
    "op4_toxicity_grammar": "toxicity",
    "op5_probed_neighbours": "neighbours",
    "op6_quality_votes": "quality_votes",
    "op7_url_rules": "url_rules",
    "op8_best_fit_packing": "packing",
    "op9_mix_sources": "mixing",
    "op10_quality_rules": "quality_rules",
    "op11_line_runs": "line_runs",
    "op12_hard_negatives": "hard_negatives",
    "op13_structure_repair": "conversations",
}


def queries() -> dict:
    return {name: getattr(import_module(f"latticework.llm.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    """SQL where it can tell the rows: learned scores, hashes of shingles, token ids, approximate searches and random mixes are tested in tests/llm against plain versions, whole texts' ids, recall and targets instead."""
    return {name: import_module(f"latticework.llm.{_WHERE[name]}").ORACLE for name in ("op10_quality_rules", "op11_line_runs", "op12_hard_negatives")}
