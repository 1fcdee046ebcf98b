"""All named queries of the library."""

from __future__ import annotations

from . import campaign, captured, dedup, diagnostics, evidence, lifecycles, listings, manifests, payloads, presence, queues, records, reports, requests, upkeep, warehouse
from .registry import Query

MODULES = [warehouse, diagnostics, presence, queues, records, captured, upkeep, dedup, lifecycles, payloads, requests, campaign, manifests, listings, evidence, reports]


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.REGISTRY.sql.items()}
