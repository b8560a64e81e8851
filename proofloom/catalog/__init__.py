"""Registered queries over the given tables, each with its SQL equivalent where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS_PER_CORE = 4


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is tested on a fixture instead."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows dealt over all cores, for much work per row: one task would read a file of few bytes."""
    return table(spark, folder, name).repartition(PARTS_PER_CORE * spark.sparkContext.defaultParallelism)


def load() -> None:
    from . import catalogue, checks, evidence, files, geometry, joins, matching, notes, operations, review, rollups  # noqa: F401
