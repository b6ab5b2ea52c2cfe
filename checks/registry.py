"""Registry of checkable queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.ctes import CTES
from checks.fixtures import Fixtures

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """Prefix a statement with the fixture expressions it names, in dependency order."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\b(?:fx|tx|rx|mx)_\w+", sql):
            if name in CTES and name not in order:
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Fixtures], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn
    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Fixtures.of(spark, sf_dir))
    return {name: bind(fn) for name, fn in QUERIES.items()}
