"""Named queries: a Spark plan, the output columns, and the SQL that must agree with it.

An output spec lists `name` or `name:kind`; kind is `d` (date as ISO text), `i` (bigint),
or a number of decimals for a double. Both sides get the same final projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.adapters import Market


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Market], DataFrame]
    out: str
    sql: str | None


QUERIES: dict[str, Query] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    """A named SQL view that oracle texts may build on."""
    VIEWS[name] = (needs, sql)


def query(name: str, out: str, sql: str | None = None, needs: str = ""):
    """Register a plan; `sql` is the body after the WITH list of the `needs` views."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        text = None
        if sql is not None:
            text = with_views(needs.split(), f"SELECT {_sql_columns(out)} FROM ({sql}) AS q")
        QUERIES[name] = Query(name, build, out, text)
        return build

    return add


def with_views(needs, body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in VIEWS[name][0]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body


def _columns(out: str):
    for item in out.split():
        name, _, kind = item.partition(":")
        yield name, kind


def _sql_columns(out: str) -> str:
    parts = []
    for name, kind in _columns(out):
        if kind == "d":
            parts.append(f"strftime({name}, '%Y-%m-%d') AS {name}")
        elif kind == "i":
            parts.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind:
            r = f"round(CAST({name} AS DOUBLE), {kind})"
            parts.append(f"CASE WHEN {r} = 0 THEN 0e0 ELSE {r} END AS {name}")
        else:
            parts.append(name)
    return ", ".join(parts)


def project(df: DataFrame, out: str) -> DataFrame:
    cols = []
    for name, kind in _columns(out):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "i":
            c = c.cast("long")
        elif kind:
            c = F.round(c.cast("double"), int(kind))
        cols.append(c.alias(name))
    return df.select(*cols)


def run(name: str, spark: SparkSession, folder: str, level: str = "nation") -> DataFrame:
    q = QUERIES[name]
    return project(q.build(Market(spark, folder, level)), q.out)
