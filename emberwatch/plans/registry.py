"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberwatch.session import INPUT_PARTITIONS, ship_code, tune

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a query; ``sql`` is the same result in DuckDB's SQL."""

    def register(function: QueryFunction) -> QueryFunction:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return function(tune(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


#: Tables whose rows cost much work each: logs and texts.
_HEAVY = ("events", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, as the session's file settings split it.

    A file of one row group cannot be split. Where ``INPUT_PARTITIONS`` is set,
    logs and texts are dealt out to that many tasks first, whatever their size.
    """
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return frame.repartition(int(parts)) if parts and name in _HEAVY else frame
