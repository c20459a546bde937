"""Named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyspark.sources.views import VIEW_SQL


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, views: str = ""):
    """Registers a query; ``views`` lists the views its SQL text refers to."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        text = None
        if sql is not None:
            body = sql.strip()
            parts = [f"{v} AS ({VIEW_SQL[v]})" for v in views.split()]
            if parts and body[:15].upper() == "WITH RECURSIVE ":
                text = "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
            elif parts and body[:5].upper() == "WITH ":
                text = "WITH " + ",\n".join(parts) + ",\n" + body[5:]
            elif parts:
                text = "WITH " + ",\n".join(parts) + "\n" + body
            else:
                text = body
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} registered twice")
        QUERIES[fn.__name__] = Query(fn.__name__, covers, fn, text)
        return fn

    return register
