"""The full query registry (imports every registry module for its side effect)."""

from __future__ import annotations

from tillroll.plans import analytics, checks, events, gold, ingest  # noqa: F401  (registration)
from tillroll.plans.catalog import REGISTRY, QueryFn


def queries() -> dict[str, QueryFn]:
    return {name: entry.fn for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.oracle for name, entry in REGISTRY.items() if entry.oracle}


def operator_ids() -> dict[str, str]:
    return {name: entry.ids for name, entry in REGISTRY.items()}
