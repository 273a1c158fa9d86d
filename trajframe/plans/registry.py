"""Registered queries of the trajectory operators, and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers (spark, sf_dir) -> DataFrame under its function's name; ``sql`` goes behind the shared views."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            from trajframe.plans.views import VIEWS

            SQL[f.__name__] = VIEWS + sql
        return f

    return add
