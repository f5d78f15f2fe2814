"""Named queries with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .bindings import SQL, Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables. sql may name the derived tables of bindings.SQL."""

    def register(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = with_bindings(sql)
        return f

    return register


def with_bindings(sql: str) -> str:
    """sql, with the derived tables that it needs in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(SQL[name])
                needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    tables = ",\n".join(f"{n} AS (\n{SQL[n].strip()}\n)" for n in needed)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{tables},\n{body[len(start) :]}"
    return f"WITH {tables}\n{body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        return run

    return {name: bind(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
