"""Functions of users: SQL expressions, aggregates and table functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ship

CREATE = re.compile(r"(?is)\s*CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*(\(.*?\))\s*RETURNS\s+(.+?)\s+(?:RETURN|AS)\s+(.+?)\s*;?\s*")


def create_sql_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A function whose body is an expression, inlined by the analyzer; ``arguments`` as '(x INT, y INT)'."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{arguments} RETURNS {returns} RETURN {body}")


def register_aggregate(spark: SparkSession, name: str, function: Callable[[pd.Series], float], returns: str = "double") -> None:
    """A function of one group's values, given as one pandas Series; a group must fit a task's memory."""
    call = lambda values: function(values)
    call.__annotations__ = {"values": pd.Series, "return": float}
    ship(spark).udf.register(name, F.pandas_udf(call, returns))


def register_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """A class with ``eval(self, ...)`` that yields rows; called in FROM, with LATERAL for each row."""
    ship(spark).udtf.register(name, F.udtf(handler, returnType=returns))
