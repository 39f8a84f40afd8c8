"""Star joins, rule look-ups and unions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.operators.sizing import small_side


@dataclass(frozen=True)
class Dim:
    """One role of a dimension: fact column, dimension key, wanted columns, prefix for their names."""

    table: DataFrame
    fact_key: str
    key: str
    columns: Sequence[str]
    prefix: str = ""


def star_join(fact: DataFrame, dims: Iterable[Dim]) -> DataFrame:
    """Left join of the fact with each dimension role; the keys of a dimension must be unique.

    Dimensions are stored tables, whose bytes Spark knows: it broadcasts those below its threshold, so the fact passes
    them in one stage, and no job runs while the plan is built. A larger one is joined by shuffle, where AQE splits the
    partition of a hot foreign key.
    """
    for i, dim in enumerate(dims):
        key = f"_dim{i}"
        side = dim.table.select(F.col(dim.key).alias(key),
                                *[F.col(c).alias(f"{dim.prefix}{c}") for c in dim.columns])
        fact = fact.join(side, F.col(dim.fact_key) == F.col(key), "left").drop(key)
    return fact


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All rows of all feeds by column name; a column that a feed lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows with a key that the parent lacks; a null key is no orphan."""
    keys = parent.select(F.col(parent_key).alias("_key"))
    return child.where(F.col(child_key).isNotNull()).join(
        small_side(keys), F.col(child_key) == F.col("_key"), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")
