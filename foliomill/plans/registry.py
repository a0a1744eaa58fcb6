"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import raster_queries, table_queries, text_queries

MODULES = (raster_queries, table_queries, text_queries)


def all_queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def all_sql() -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(module.SQL)
    return out
