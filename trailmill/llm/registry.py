"""The corpus queries. Each module's ``query`` applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_packing": "packing",
    "op2_simhash_near_dedup": "simhash",
    "op3_html_extraction": "html_extract",
    "op4_quality_rules": "quality",
    "op5_secret_scans": "secret_scan",
    "op6_substring_dedup": "substring_dedup",
    "op7_license_scans": "license_scan",
    "op8_language_model": "language_model",
    "op9_decontamination": "decontam",
    "op10_chat_formatting": "chat_format",
    "op11_source_divergence": "divergence",
    "op12_bpe_codec": "bpe_codec",
    "op13_leaderboard_feed": "leaderboard",
}

QUERIES = {}
ORACLES = {}
for _name, _module in _MODULES.items():
    _found = import_module(f"trailmill.llm.{_module}")
    QUERIES[_name] = _found.query
    if _found.ORACLE_SQL:
        ORACLES[_name] = _found.ORACLE_SQL
