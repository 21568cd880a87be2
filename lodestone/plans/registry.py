"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "label_balance_report"


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


from lodestone.plans import annotation, datasets, evaluation, statistics  # noqa: E402, F401
