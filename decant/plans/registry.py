"""Query registry: each entry pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def cte(name: str, sql: str, *needs: str) -> None:
    """Register a named SQL building block used by the oracles."""
    CTES[name] = (needs, sql.strip())


def with_(*names: str) -> str:
    """``WITH`` clause holding the named blocks and whatever they need, in order."""
    done: dict[str, str] = {}

    def visit(n: str) -> None:
        if n in done:
            return
        needs, sql = CTES[n]
        for m in needs:
            visit(m)
        done[n] = sql

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in done.items()) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII expression on the checking engine, which has no such function: one division step per bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    step = "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295::BIGINT)"
