"""Queries over the test tables, each with its SQL counterpart where there is one."""

from __future__ import annotations

import importlib

#: Modules that each define QUERIES and SQL.
MODULES = ("timestamps", "demand", "retrieval", "texts", "sampling", "fidelity", "judgements")


def _merged(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), what)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
