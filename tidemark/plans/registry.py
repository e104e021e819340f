"""Query registry. One column list drives both sides, so names, types and rounding agree.

Column kinds: s text, i whole number, f rounded number (f4 = 4 places, default 6), d date as
yyyy-MM-dd, t time to the millisecond, b truth value as 0/1.

Numbers are nudged by a fixed hair before rounding: values that end half-way, such as a mean of
two prices, would otherwise round up on one engine and down on the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.views_sql import with_views
from tidemark.sources.testdata import Tables


@dataclass(frozen=True)
class Query:
    name: str
    make: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None
    views: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, views: Sequence[str] = ()):
    spec = tuple(tuple(c.rsplit(":", 1)) for c in columns.split())

    def register(make):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, make, spec, sql, tuple(views))
        return make

    return register


def _places(kind: str) -> tuple[int, str]:
    places = int(kind[1:] or 6)
    return places, f"1.2345678e-{places + 2}"


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "s":
        c = c.cast("string")
    elif kind in ("i", "b"):
        c = c.cast("bigint")
    elif kind[0] == "f":
        places, nudge = _places(kind)
        c = F.round(c.cast("double") + float(nudge), places)
    elif kind == "d":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind == "t":
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    c = f'q."{name}"'
    if kind == "s":
        c = f"CAST({c} AS VARCHAR)"
    elif kind in ("i", "b"):
        c = f"CAST({c} AS BIGINT)"
    elif kind[0] == "f":
        places, nudge = _places(kind)
        c = f"round(CAST({c} AS DOUBLE) + {nudge}, {places}) + 0.0"
    elif kind == "d":
        c = f"strftime({c}, '%Y-%m-%d')"
    elif kind == "t":
        c = f"strftime({c}, '%Y-%m-%d %H:%M:%S.%g')"
    return f'{c} AS "{name}"'


def build(name: str, spark: SparkSession, folder: str) -> DataFrame:
    q = QUERIES[name]
    return q.make(Tables(spark, folder)).select(*[_spark_column(*c) for c in q.columns])


def sql_text(name: str) -> str | None:
    q = QUERIES[name]
    if q.sql is None:
        return None
    columns = ", ".join(_sql_column(*c) for c in q.columns)
    return f"{with_views(q.views)}SELECT {columns} FROM ({q.sql}) AS q"
