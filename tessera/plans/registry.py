"""Query registry feeding ``__spark_entry__``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "tessera.plans.q_core",
    "tessera.plans.q_order",
    "tessera.plans.q_text",
    "tessera.plans.q_pairs",
    "tessera.plans.q_profile",
    "tessera.plans.q_pool",
    "tessera.plans.q_ensemble",
    "tessera.plans.q_io",
    "tessera.plans.q_windows",
    "tessera.plans.q_stream",
    "tessera.plans.q_ml",
    "tessera.plans.q_foldreg",
    "tessera.plans.q_segments",
]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all():
    for m in MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLES
