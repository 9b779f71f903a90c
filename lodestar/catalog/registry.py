"""All registered core queries."""

from __future__ import annotations

import importlib

MODULES = ("integrity", "retrieval", "inventory", "structure", "streams", "paths", "evidence", "pycode", "planning", "structures")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
