"""All registered queries."""

from __future__ import annotations

import importlib

from emberwatch.plans.registry import ORACLES, QUERIES, QueryFunction

MODULES = [
    "q_predicates",
    "q_detection",
    "q_documents",
    "q_search",
    "q_sources",
    "q_lookups",
    "q_analytics",
    "q_temporal",
    "q_streaming",
    "q_functions",
]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"emberwatch.plans.{name}")


def queries() -> dict[str, QueryFunction]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
