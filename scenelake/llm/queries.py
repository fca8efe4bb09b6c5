"""Queries and SQL of this subpackage for the driver's contract."""

from __future__ import annotations

import importlib

#: Query name -> module and function.
OPERATORS = {
    "op1_simhash": ("op1_simhash", "op1"),
    "op2_toxicity": ("op2_toxicity", "op2"),
    "op3_mix": ("op3_mix", "op3"),
    "op4_substring": ("op4_substring", "op4"),
    "op5_decontaminate": ("op5_decontaminate", "op5"),
    "op6_licenses": ("op6_licenses", "op6"),
    "op7_suffix": ("op7_suffix", "op7"),
    "op8_language": ("op8_language", "op8"),
    "op9_tiff": ("op9_tiff", "op9"),
    "op10_tokens": ("op10_tokens", "op10"),
}


def queries() -> dict:
    out = {name: getattr(importlib.import_module(f"scenelake.llm.{module}"), function) for name, (module, function) in OPERATORS.items()}
    return out


def oracle_sql() -> dict[str, str]:
    from scenelake.llm import op3_mix, op4_substring, op7_suffix

    return {"op3_mix": op3_mix.oracle(), "op4_substring": op4_substring.oracle(), "op7_suffix": op7_suffix.oracle()}
