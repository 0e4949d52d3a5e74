"""The query registry.

A query declares its output columns once; the same declaration types and rounds the Spark
result and wraps the oracle SQL, so both sides always agree on names, widths and places.

Column kinds: s string, l long, n long shown as -1 where it is NULL (client libraries give
nullable integers different types), d double (6 places), b boolean, al / as / ad arrays of
long / string / double, shown as text joined by commas (ad in millionths).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Keeps exact rounding ties off the edge; sums differ in the last bit between engines.
NUDGE = 1e-9


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable
    cols: list[tuple[str, str]]
    sql: str | None


class Tables:
    """Lazy readers for one scale-factor folder, plus the stand-in views of `standins`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        from seedloom.plans import standins

        make = standins.FRAMES.get(name)
        if make is None:
            raise AttributeError(name)
        return make(self)


REGISTRY: dict[str, Query] = {}


def query(name: str, cols: str, sql: str | None = None):
    pairs = [tuple(c.split(":")) for c in cols.split()]

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, pairs, sql)
        return fn

    return wrap


def _spark_col(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "l":
        return c.cast("long").alias(name)
    if kind == "n":
        return F.coalesce(c.cast("long"), F.lit(-1).cast("long")).alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    if kind == "d":
        return F.round(c.cast("double") + F.lit(NUDGE), 6).alias(name)
    if kind == "as":
        return F.array_join(c, ",").alias(name)
    if kind == "al":
        return F.array_join(F.transform(c, lambda v: v.cast("long").cast("string")), ",").alias(name)
    if kind == "ad":
        return F.array_join(
            F.transform(c, lambda v: F.floor(v.cast("double") * 1e6 + 0.4987).cast("string")), ","
        ).alias(name)
    raise ValueError(kind)


def _sql_col(name: str, kind: str) -> str:
    q = f'"{name}"'
    form = {
        "s": f"CAST({q} AS VARCHAR)",
        "l": f"CAST({q} AS BIGINT)",
        "n": f"COALESCE(CAST({q} AS BIGINT), CAST(-1 AS BIGINT))",
        "b": f"CAST({q} AS BOOLEAN)",
        "d": f"ROUND(CAST({q} AS DOUBLE) + {NUDGE}, 6)",
        "as": f"array_to_string({q}, ',')",
        "al": f"array_to_string(list_transform({q}, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',')",
        "ad": f"array_to_string(list_transform({q}, lambda v: CAST(CAST(floor(CAST(v AS DOUBLE) * 1e6 + 0.4987) AS BIGINT) AS VARCHAR)), ',')",
    }[kind]
    return f"{form} AS {q}"


def _load() -> None:
    from seedloom.plans import catalog  # noqa: F401


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(q: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = q.run(Tables(spark, sf_dir))
            return out.select(*[_spark_col(n, k) for n, k in q.cols])

        run.__name__ = q.name
        return run

    return {n: bind(q) for n, q in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    _load()
    from seedloom.plans import standins

    out = {}
    for n, q in REGISTRY.items():
        if q.sql is None:
            continue
        picked = ", ".join(_sql_col(c, k) for c, k in q.cols)
        out[n] = f"{_with(q.sql, standins.VIEWS)}\nSELECT {picked} FROM answer"
    return out


def _with(sql: str, views: dict[str, str]) -> str:
    """Prefix the stand-in views that ``sql`` mentions and name its result ``answer``."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in views.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    head = [f"{v} AS ({views[v]})" for v in needed]
    return "WITH " + ",\n".join(head + [f"answer AS ({sql})"])
