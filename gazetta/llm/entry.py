"""Queries of this subpackage for the driver's registry."""

from __future__ import annotations

from gazetta.llm import base_columns, fertility, html_extract, jaccard_join, license_scan, media_audio, merge_dropout, mixing, packing, preference, quality_rules, secret_scan, spelling, whitening

MODULES = (html_extract, media_audio, fertility, license_scan, preference, merge_dropout, secret_scan, jaccard_join, mixing, quality_rules, spelling, whitening, packing, base_columns)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
