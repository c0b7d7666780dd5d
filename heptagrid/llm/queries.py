"""The queries of this subpackage for the driver, and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Module and function of each.
QUERIES = {
    "op1_token_records": "token_records",
    "op2_byte_bpe": "byte_bpe",
    "op3_url_filters": "url_filters",
    "op4_fingerprints": "fingerprints",
    "op5_token_counts": "token_counts",
    "op6_quality_classifier": "quality_classifier",
    "op7_quality_rules": "quality_rules",
    "op8_html_extraction": "html_extraction",
    "op9_jaccard_join": "jaccard_join",
    "op10_packing": "packing",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .quality_rules import ORACLE_SQL

    return {"op7_quality_rules": ORACLE_SQL}
