"""Registered queries: each names an operator, its tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import importlib

from tessella.plans.registry import ORACLES, QUERIES, Query

_PACKS = ("analytics", "texts", "retrieval", "ingest", "state", "paths", "reports", "sinks")


def all_queries() -> dict[str, Query]:
    for pack in _PACKS:
        importlib.import_module(f"{__name__}.{pack}")
    return QUERIES


def all_oracles() -> dict[str, str]:
    all_queries()
    return ORACLES
