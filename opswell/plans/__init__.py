"""The registered queries, one module per family."""

from __future__ import annotations

import importlib

from opswell.registry import QUERIES, Query

FAMILIES = [
    "sources",
    "projections",
    "joins",
    "aggregates",
    "windows",
    "ordering",
    "scalars",
    "lifecycle",
    "logs",
    "stages",
    "reconcile",
    "alerts",
    "functions",
]


def load() -> dict[str, Query]:
    for name in FAMILIES:
        importlib.import_module(f"opswell.plans.{name}")
    return QUERIES
