"""Query registry and the shared common table expressions of the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """Define a reusable SQL expression; ``needs`` are the ones it reads."""
    _CTES[name] = (needs, body)


def ctes() -> dict[str, tuple[tuple[str, ...], str]]:
    """The expressions defined so far: what each needs, and its body."""
    return dict(_CTES)


def with_ctes(body: str, *needs: str) -> str:
    """``WITH`` clause with ``needs`` and everything below them, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    parts = []
    recursive = False
    for name in order:
        text = _CTES[name][1]
        head = name
        if text.startswith("RECURSIVE "):
            recursive = True
            text = text[len("RECURSIVE "):]
        parts.append(f"{head} AS ({text})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its twin."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql, *needs)
        return fn

    return add


def twin(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """The twin of a query registered before the expressions it needs were defined."""
    if name not in QUERIES or name in ORACLE:
        raise ValueError(f"no query waits for this twin: {name}")
    ORACLE[name] = with_ctes(sql, *needs)
