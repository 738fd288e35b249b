"""All registered queries of the library and, where SQL can express them, their SQL."""

from __future__ import annotations

from .plans import queries as _queries

MODULES = (_queries,)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
