"""Registered queries: every operator on the given tables, next to its check in SQL."""

from __future__ import annotations

from importlib import import_module

from .base import REGISTRY, Entry

MODULES = ("sources", "cases", "filters", "quality", "scoring", "reports", "explain", "transforms", "flow", "eda", "match", "documents")


def load() -> dict[str, Entry]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
