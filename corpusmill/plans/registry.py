"""Queries by name, each with the operators that it runs and, where SQL can say it, an equivalent for another engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
# Rows of a table for each partition into which it is dealt.
ROWS = 1 << 19


class Tables:
    """The tables of a folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Into how many partitions a table's rows are dealt; rows are counted from the footers of its files."""
        return -(-getattr(self, name).count() // ROWS)


def query(name: str, covers: str, sql: str | None = None):
    """Registers a function of Tables under ``name``; ``covers`` lists operator ids."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"{name} is there already")
        REGISTRY[name] = Query(name, tuple(covers.split()), lambda spark, folder: f(Tables(spark, folder)), sql)
        return f

    return register
