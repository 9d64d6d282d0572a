"""Contract queries with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

from tabularium.plans.contract import ORACLES, QUERIES, Query

_MODULES = ("retrieval", "ingest", "bookkeeping", "spreadsheets", "tablefiles", "star", "media", "stores", "plugins", "streams")


def _load() -> None:
    for name in _MODULES:
        import_module(f"tabularium.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
