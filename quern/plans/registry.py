"""The register of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a data folder, read when named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def views(self, *names: str) -> SparkSession:
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark


def query(sql: str | None = None):
    """Register a function of Tables under its own name, with its SQL if there is one."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(ship(spark), sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(c, digits: int = 4):
    return F.round(c, digits)
