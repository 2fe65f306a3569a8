"""Named queries and their equivalents in SQL, one module per area."""

from __future__ import annotations

import importlib

_AREAS = ["stats", "text", "gates", "records", "planning", "sources", "nested"]


def registered() -> dict:
    out: dict = {}
    for area in _AREAS:
        out |= importlib.import_module(f"{__name__}.{area}").queries()
    return out


def registered_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for area in _AREAS:
        out |= importlib.import_module(f"{__name__}.{area}").oracle_sql()
    return out
