"""All queries of the market library, by name."""

from __future__ import annotations

from . import catalogue, desk, events, ingest, market, runs, streaming

_MODULES = (market, ingest, desk, catalogue, events, runs, streaming)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
