"""Named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_BODIES: dict[str, tuple[str, tuple[str, ...]]] = {}
_CTES: dict[str, tuple[tuple[str, ...], str, str]] = {}


def naive(df: DataFrame) -> DataFrame:
    """UTC instants as plain timestamps and dates as ISO text, the form plain SQL returns."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so float summation order does not show."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), special.get(f.name, digits))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query; `sql` is its oracle body, `ctes` the shared views it reads."""
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive(fn(configure(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            _BODIES[name] = (sql, ctes)
        return run
    return register


def oracles() -> dict[str, str]:
    return {name: compose(sql, ctes) for name, (sql, ctes) in _BODIES.items()}


def cte(name: str, sql: str, deps: tuple[str, ...] = (), materialized: bool = False) -> None:
    _CTES[name] = (deps, sql.strip(), "MATERIALIZED " if materialized else "")


def compose(body: str, ctes: tuple[str, ...]) -> str:
    """One statement from a body and the shared views it reads, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for n in ctes:
        visit(n)
    body = body.strip()
    if not order:
        return body
    parts = ",\n".join(f"{n} AS {_CTES[n][2]}(\n{_CTES[n][1]}\n)" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {parts},\n{body[5:].lstrip()}"
    return f"WITH RECURSIVE {parts}\n{body}"
