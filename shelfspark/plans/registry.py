"""Registry of the queries bound to the fixture tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.session import read_widely, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL counterpart where SQL can say it."""
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(read_widely(tune(spark)), folder))
        run.__doc__ = build.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register
