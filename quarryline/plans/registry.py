"""Where the modules of registered queries put them, each with equivalent SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def fixed_sql(x: str, places: int) -> str:
    """SQL of ``to_fixed`` for numbers from 0: printf rounds exact values, but exact ties (which are dyadic) to even."""
    return f"CASE WHEN ({x}) * 32 = floor(({x}) * 32) THEN floor(({x}) * {10**places} + 0.5) / {10**places}::DOUBLE ELSE CAST(printf('%.{places}f', {x}) AS DOUBLE) END"
