"""Collects a module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registrar(queries: dict, oracles: dict) -> Callable:
    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return query
