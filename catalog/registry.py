"""Query registry. A column list such as ``series_id, ts:t, value:6`` formats both sides alike:

``:t`` as text, ``:i`` as bigint, ``:<digits>`` rounded, no suffix as is. Before rounding, both sides are shifted by a
seventieth of the last digit: values that end in an exact half would else round up or down with the order of summing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.functions.columns import quoted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple((c.strip() + ":").split(":")[:2]) for c in columns.split(",")]


def _shift(digits: str) -> float:
    return 10.0 ** -int(digits) / 70


def _spark_column(name: str, kind: str) -> Column:
    c = quoted(name)
    if kind == "t":
        c = c.cast("string")
    elif kind == "i":
        c = c.cast("bigint")
    elif kind:
        c = F.round(c.cast("double") + F.lit(_shift(kind)), int(kind))
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "t":
        c = f"CAST({c} AS VARCHAR)"
    elif kind == "i":
        c = f"CAST({c} AS BIGINT)"
    elif kind:
        c = f"round(CAST({c} AS DOUBLE) + {_shift(kind)!r}::DOUBLE, {kind})"
    return f'{c} AS "{name}"'


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    spec = _parse(columns)

    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: build(spark, sf_dir).select(*[_spark_column(*c) for c in spec])
        if sql is not None:
            ORACLES[name] = f"SELECT {', '.join(_sql_column(*c) for c in spec)} FROM ({sql}) AS q"
        return build

    return register
