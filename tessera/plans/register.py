"""How a plan is registered: a function of the report tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.analogue import BASE_SQL, Reports

PLANS: dict[str, tuple[Callable[[Reports], DataFrame], str | None]] = {}


def plan(sql: str | None = None, base: bool = True) -> Callable:
    def keep(f: Callable[[Reports], DataFrame]) -> Callable[[Reports], DataFrame]:
        text = None if sql is None else (BASE_SQL + (", " + sql if sql.lstrip().startswith("@") else sql)).replace(", @", ", ") if base else sql
        PLANS[f.__name__] = (f, text)
        return f

    return keep
