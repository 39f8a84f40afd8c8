"""Queries by name, each with the SQL that gives the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: without_zone(fn(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return fn
    return add


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as plain UTC date and time, as the SQL side gives them."""
    zoned = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    if not zoned:
        return df
    return df.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if c in zoned else F.col(f"`{c}`")
                       for c in df.columns])
