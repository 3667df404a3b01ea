"""The registry of named queries and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cotejo.plans.relations import RELATIONS, Corpus, closure, oracle_ctes

QUERIES: dict[str, Callable[[Corpus], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}  # extra CTEs of the checking side, name -> SELECT


def view(name: str, sql: str) -> str:
    """Register a reusable CTE of the checking SQL."""
    VIEWS[name] = sql
    return name


def oracle(body: str) -> str:
    """Complete ``body`` (``[name AS (...), ...] SELECT ...``) with the CTEs it names."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                if n not in order:
                    order.append(n)

    visit(body)
    everything = body + "".join(VIEWS[v] for v in order)
    base = [n for n in re.findall(r"[a-z_0-9]+", everything) if n in RELATIONS]
    parts = [oracle_ctes(base)] if closure(base) else []
    parts += [f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order]
    body = body.strip()
    if re.match(r"(?i)select\b", body):
        return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
    return "WITH " + ",\n".join(parts + [body])


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its check."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, folder: fn(Corpus(spark, folder))
    return {n: bind(fn) for n, fn in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {n: oracle(sql) for n, sql in ORACLES.items()}
