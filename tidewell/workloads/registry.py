"""Registry of the queries the repository offers, each with an optional SQL statement of the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.dataset import VIEW_SQL, Dataset

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prepend the logical views that ``sql`` mentions, so it runs on the base tables alone."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(dataset) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Dataset], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Dataset(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
