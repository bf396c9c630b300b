"""Registered queries over the given tables, each with the SQL it is checked against."""

from __future__ import annotations

from importlib import import_module

from deskwise.catalog.registry import ORACLE, QUERIES

MODULES = ("corpus", "retrieval", "evaluation", "triage", "models", "streams", "similarity")


def _load() -> None:
    for name in MODULES:
        import_module(f"deskwise.catalog.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
