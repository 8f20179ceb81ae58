"""The operN queries and, where SQL can state the same result, their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this subpackage that register queries (``QUERIES`` and ``ORACLES``).
MODULES = ("urls", "neardup", "topk", "extract", "warc", "tokens", "packing", "decontam", "quality", "pii")


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"foliant.llm.{name}"), attribute))
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
