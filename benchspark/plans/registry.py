"""Collects the named queries of the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["scoring", "freezing", "curation", "assembly", "annotation", "labelling", "answers", "logs"]


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register the function under its own name; ``ctes`` name shared views of ``bindings.CTES``."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_views(sql, ctes)
        return fn

    return register


def with_views(sql: str, ctes: tuple[str, ...]) -> str:
    from benchspark.plans.bindings import CTES

    if not ctes:
        return sql
    views = ",\n".join(f"{name} AS ({CTES[name]})" for name in ctes)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


@cache
def _load() -> None:
    for name in MODULES:
        import_module(f"benchspark.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
