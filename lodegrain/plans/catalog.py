"""The registry of queries over the supplied tables: a Spark function and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register a function (Views) -> DataFrame under its name; `views` are common table expressions the SQL uses."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Views(spark, sf_dir))

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = (f"WITH {views}\n" if views else "") + sql
        return function

    return register


class Views:
    """The supplied tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
