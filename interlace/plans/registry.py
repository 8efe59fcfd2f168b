"""Where queries are kept by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


class Registry:
    """Queries by name; each is written as a function of the tables."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def kept(make: Callable[[Tables], DataFrame]):
            key = name or make.__name__
            self.queries[key] = lambda spark, folder: make(Tables(spark, folder))
            if sql:
                self.oracles[key] = sql
            return make

        return kept
