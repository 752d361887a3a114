"""Where the catalogue's queries and their DuckDB twins are kept."""

from __future__ import annotations

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep
