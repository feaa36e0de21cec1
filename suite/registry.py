"""Query registration and the composition of oracle SQL from shared views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named common table expression usable by every oracle."""
    VIEWS[name] = sql.strip()


def compose(select: str) -> str:
    """Prefix ``select`` with the views it needs, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", sql):
                seen.add(name)
                visit(VIEWS[name])
                order.append(name)

    visit(select)
    if not order:
        return select.strip()
    parts = []
    for n in order:
        head = re.match(r"\((\w+(?:\s*,\s*\w+)*)\)\s*", VIEWS[n]) if VIEWS[n].startswith("(") else None
        body = VIEWS[n][head.end():] if head else VIEWS[n]
        recursive = re.search(rf"\b{n}\b", body) is not None
        parts.append(f"{n}{head.group(0).strip() if head else ''} AS {'' if recursive else 'MATERIALIZED '}({body})")
    select = select.strip()
    own = select.upper().startswith("WITH ")  # the query brings further views of its own
    return "WITH RECURSIVE " + ",\n".join(parts) + (",\n" + select[5:] if own else "\n" + select)


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name`` with its oracle."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    return {name: compose(sql) for name, sql in ORACLES.items()}
