"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablekit.functions.columns import col
from tablekit.functions.session import shared_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A new folder every executor can reach."""
        return f"{shared_root(self.spark)}/{name}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    """Register f(tables) under a name, with its SQL counterpart if there is one."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of two engines' sums do not count."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(col(c), digits) + 0.0 for c in names}) if names else df


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round({expression}, {digits}) + 0.0"


def joined(df: DataFrame, names: list[str]) -> DataFrame:
    """Array columns as text."""
    return df.withColumns({c: F.concat_ws(",", col(c)) for c in names})
