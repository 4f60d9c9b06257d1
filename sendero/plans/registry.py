"""Query registry: name -> (spark, sf_dir) -> DataFrame, and the oracle
SQL of each.  Every query reads the base tables of ``sf_dir`` (through the
bindings) and covers the whole of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sendero.plans.pipeline import Pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle_sql: str | None = None):
    def deco(fn: Callable[[Pipeline], DataFrame]) -> Callable[[Pipeline], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Pipeline(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle_sql is not None:
            ORACLE[name] = oracle_sql
        return fn

    return deco
