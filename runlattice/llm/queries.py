"""The queries and oracles of this subpackage, by name."""

from __future__ import annotations

import importlib

#: Name of the query to its module; the module has a function of that name and perhaps SQL.
MODULES = {
    "op1_secret_scans": "secrets",
    "op2_ngram_jaccard_join": "jaccard",
    "op3_decontamination": "decontamination",
    "op4_language_id": "language",
    "op5_quality_classifier": "perplexity",
    "op6_quality_rules": "quality_rules",
    "op7_line_dedup": "line_dedup",
    "op8_weighted_mixing": "mixing",
    "op9_suffix_array_dedup": "suffix_dedup",
    "op10_html_extraction": "html",
}


def _module(name: str):
    return importlib.import_module(f"runlattice.llm.{MODULES[name]}")


def _query(name: str):
    return lambda spark, sf_dir: getattr(_module(name), name)(spark, sf_dir)


def queries() -> dict:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).SQL for name in MODULES if getattr(_module(name), "SQL", None)}
