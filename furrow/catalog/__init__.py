"""Named queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

import importlib

AREAS = ["ingest", "scalars", "joins", "aggregates", "windows", "forecasts", "streams"]


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"furrow.catalog.{area}")


def all_queries():
    from furrow.catalog.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_twins():
    from furrow.catalog.registry import ORACLE

    _load()
    return dict(ORACLE)
