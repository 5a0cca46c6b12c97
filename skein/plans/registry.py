"""How queries are registered, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrar(queries: dict) -> Callable:
    """A decorator that puts a function of tables (named by its parameters) into `queries` with its oracle SQL."""

    def query(sql: str | None = None):
        def put(f):
            names = f.__code__.co_varnames[: f.__code__.co_argcount]

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(*(table(spark, sf_dir, n) for n in names))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            queries[f.__name__] = (run, sql)
            return f

        return put

    return query
